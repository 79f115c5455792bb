"""Names that published results must carry."""

# IANA protocol numbers that are shown by name.
PROTOCOLS = {
    1: "icmp", 2: "igmp", 4: "ipv4", 6: "tcp", 17: "udp", 41: "ipv6", 47: "gre", 50: "esp", 51: "ah", 58: "icmpv6",
    88: "eigrp", 89: "ospf", 103: "pim", 112: "vrrp", 132: "sctp",
}

# TCP flags by bit, lowest first.
TCP_FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")

# DSCP code points that are shown by name.
DSCP = {
    0: "cs0", 1: "le", 8: "cs1", 10: "af11", 12: "af12", 14: "af13", 16: "cs2", 18: "af21", 20: "af22", 22: "af23", 24: "cs3", 26: "af31",
    28: "af32", 30: "af33", 32: "cs4", 34: "af41", 36: "af42", 38: "af43", 40: "cs5", 44: "voice-admit", 45: "nqb", 46: "ef", 48: "cs6", 56: "cs7",
}

# Service ports of TCP and UDP, of TCP alone, and of UDP alone.
SERVICES_BOTH = {
    21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp", 69: "tftp", 80: "http", 88: "kerberos", 123: "ntp",
    135: "msrpc", 137: "netbios", 138: "netbios", 139: "netbios", 161: "snmp", 162: "snmp-trap", 179: "bgp", 389: "ldap", 445: "smb",
    514: "syslog", 547: "dhcpv6", 587: "submission", 636: "ldaps", 993: "imaps", 1433: "mssql", 1812: "radius", 1813: "radius-acct",
    2049: "nfs", 3128: "http-proxy", 3306: "mysql", 3389: "rdp", 4500: "ipsec-nat-t", 5060: "sip", 5432: "postgresql", 6379: "redis",
    8080: "http-alt", 8443: "https-alt", 27017: "mongodb",
}
SERVICES_TCP = {443: "https", 853: "dns-over-tls", 2083: "radsec"}
SERVICES_UDP = {443: "http3", 500: "isakmp", 853: "dns-over-quic", 2055: "netflow", 4739: "ipfix", 4789: "vxlan", 6343: "sflow"}

TCP, UDP = 6, 17
SERVICES = sorted(
    [(p, port, name) for p in (TCP, UDP) for port, name in SERVICES_BOTH.items()]
    + [(TCP, port, name) for port, name in SERVICES_TCP.items()]
    + [(UDP, port, name) for port, name in SERVICES_UDP.items()]
)

#: the greatest unsigned 64-bit number, at which corrected counts stop
U64 = 18446744073709551615
