"""NetFlow 9 and IPFIX: devices announce layouts, samplers and applications that later records need.

`Device` is the state of one exporter and is fed its datagrams in order of arrival. It knows nothing of
Spark; batch and streaming jobs drive the same class.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from struct import unpack_from

from ..operators.tracking import Declarations, PacketLoss, RecordLoss
from . import packets

WRAP = 1 << 32
SKEW_MS = 3_600_000
VARIABLE = 0xFFFF
NAME_BYTES = 255
PEN_CATEGORY = (9, 12232)  # the vendor's element that names an application's category
MS = 1000


@dataclass(frozen=True)
class Element:
    number: int
    length: int
    enterprise: int = 0


@dataclass
class Layout:
    elements: tuple[Element, ...]
    scopes: int = 0
    options: bool = False
    seen: float = 0.0

    @property
    def least(self) -> int:
        return sum(1 if e.length == VARIABLE else e.length for e in self.elements)

    @property
    def variable(self) -> bool:
        return any(e.length == VARIABLE for e in self.elements)


@dataclass(frozen=True)
class Limits:
    fields: int = 128
    layouts: int = 8192
    domains: int = 256
    ttl: float = 1800.0
    applications: int = 16384
    samplers: int = 256
    fields_held: int = 65536


@dataclass
class Domain:
    layouts: dict[tuple[int, int], Layout] = field(default_factory=dict)
    packets: dict[int, PacketLoss] = field(default_factory=dict)
    records: dict[int, RecordLoss] = field(default_factory=dict)
    unresolved: int = 0
    inversions: int = 0
    seen: float = 0.0


class Malformed(Exception):
    pass


def number(raw: bytes, most: int = 8) -> int | None:
    """A big-endian number of 1 to 8 bytes that fits in `most`; None else."""
    if not 1 <= len(raw) <= 8:
        return None
    n = int.from_bytes(raw, "big")
    return n if n < 1 << 8 * most else None


def name(raw: bytes) -> str | None:
    """A device's string without padding; None if it is empty, too long or not UTF-8."""
    text = raw.rstrip(b"\0 ")
    if not 0 < len(text) <= NAME_BYTES:
        return None
    try:
        return text.decode()
    except UnicodeDecodeError:
        return None


def application_id(raw: bytes) -> int | None:
    """Engine in the first byte, a selector of less than 24 bits in the rest, as one number."""
    if len(raw) < 2:
        return None
    selector = int.from_bytes(raw[1:], "big")
    return raw[0] << 24 | selector if selector < 1 << 24 else None


def anchored(export_us: int, uptime: int, reading: int) -> int:
    """Microseconds at which the uptime was `reading` ms, given the export's instant and uptime."""
    age = (uptime - reading) % WRAP
    return export_us - (age - WRAP if age > WRAP - SKEW_MS else age) * MS


# Element number -> (column, greatest width in bytes).
PLAIN = {
    1: ("bytes", 8), 2: ("packets", 8), 3: ("flows", 8), 23: ("out_bytes", 8), 24: ("out_packets", 8), 4: ("protocol", 1), 5: ("tos", 1), 7: ("src_port", 2), 11: ("dst_port", 2),
    9: ("src_mask", 1), 29: ("src_mask", 1), 13: ("dst_mask", 1), 30: ("dst_mask", 1), 10: ("input_if", 4), 14: ("output_if", 4), 16: ("src_as", 4), 17: ("dst_as", 4),
    48: ("sampler", 4), 302: ("selector", 4), 22: ("first", 4), 21: ("last", 4), 312: ("frame_size", 8),
}
ADDRESSES = {8: ("src4", 4), 12: ("dst4", 4), 27: ("src6", 16), 28: ("dst6", 16)}
#: element -> (column, microseconds of one unit, native width)
INSTANTS = {150: ("start", 1_000_000, 4), 151: ("end", 1_000_000, 4), 152: ("start", 1000, 8), 153: ("end", 1000, 8), 160: ("boot", 1000, 8)}
SECTIONS = {104: "frame", 315: "frame", 313: "ip"}
NAMES = (96, 56701)
DSCP, FLAGS, DIRECTION, APPLICATION = 195, 6, 61, 95
#: elements of options records
RATES = {34: "plain", 50: "random", 305: "interval", 306: "space", 309: "size", 310: "population"}
IPFIX_SCOPES = {145: ("template", 2), 10: ("interface", 4), 149: ("domain", 4)}
V9_SCOPES = {5: ("template", 2), 2: ("interface", 4)}

KNOWN = {*PLAIN, *ADDRESSES, *INSTANTS, *SECTIONS, *NAMES, DSCP, FLAGS, DIRECTION, APPLICATION, *RATES}


def read_fields(values: list[tuple[Element, bytes]]) -> dict:
    """What a data record says, before anything is resolved. Values that do not fit are not there."""
    out: dict = {}
    for e, raw in values:
        if e.enterprise:
            continue
        k = e.number
        if k in PLAIN:
            column, most = PLAIN[k]
            if (n := number(raw, most)) is not None:
                out[column] = n
        elif k in ADDRESSES:
            column, size = ADDRESSES[k]
            if len(raw) == size:
                out[column] = packets.address(raw)
        elif k in INSTANTS:
            column, unit, size = INSTANTS[k]
            if len(raw) == size and (n := int.from_bytes(raw, "big")):
                out[column] = n * unit
        elif k in SECTIONS:
            out[SECTIONS[k]] = raw
        elif k in NAMES and (text := name(raw)):
            out["app_name"] = text
        elif k == DSCP and (n := number(raw, 1)) is not None and n <= 63:
            out.setdefault("tos", n << 2)
        elif k == FLAGS and (n := number(raw, 2)) is not None:
            out["tcp_flags"] = n & 255
        elif k == DIRECTION:
            out["direction"] = {0: "ingress", 1: "egress"}.get(number(raw, 1), "unknown")
        elif k == APPLICATION and (n := application_id(raw)) is not None:
            out["app_id"] = n
    return out


def addresses(f: dict) -> dict:
    """The family that holds an address; the other only fills what it lacks."""
    pairs = [(f.get("src4"), f.get("dst4")), (f.get("src6"), f.get("dst6"))]
    holds = [any(a is not None and any(a) for a in p) for p in pairs]
    first, second = (pairs[1], pairs[0]) if holds[1] and not holds[0] else pairs
    return {k: v for k, v in zip(("src_addr", "dst_addr"), (first[i] if first[i] is not None else second[i] for i in (0, 1)), strict=True) if v is not None}


class Device:
    """Everything that one exporter has announced."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits
        self.domains: dict[tuple[str, int], Domain] = {}
        self.samplers = {"netflow_v9": Declarations(limits.samplers), "ipfix": Declarations(limits.samplers)}
        self.applications: dict[int, dict[str, str]] = {}
        self.announced = 0.0  # when an application was last announced
        self.unread: set[tuple[int, int]] = set()
        self.refused = dict.fromkeys(("domains", "applications", "strings", "layouts"), 0)

    def notes(self) -> list[tuple[str, int | None, str, int]]:
        """(version, domain, what, number) of all that the device's state counts; version and domain of the device as a whole are '' and None."""
        out = []
        for (version, odid), d in sorted(self.domains.items()):
            missed = sum(x.missed for x in (d.packets if version == "netflow_v9" else d.records).values())
            counts = {"sequence_missed": missed, "templates": len(d.layouts), "sampling_unresolved": d.unresolved, "clock_inversions": d.inversions}
            out += [(version, odid, k, n) for k, n in counts.items()]
        for version, table in self.samplers.items():
            out += [(version, None, "declarations_refused", table.refused), (version, None, "sampler_rate_changes", table.changes)]
        out += [("", None, f"{k}_refused", n) for k, n in self.refused.items()]
        return out + [("", None, f"unread {enterprise}:{number}", 1) for enterprise, number in sorted(self.unread)]

    def decode(self, payload: bytes, port: int = 0, now: float = 0.0) -> tuple[list[dict], list[str]]:
        """(records, errors) of a datagram. One that is malformed gives no records."""
        version = unpack_from(">H", payload)[0] if len(payload) >= 4 else 0
        walk = {9: self._netflow9, 10: self._ipfix}.get(version)
        if walk is None:
            return [], ["malformed" if len(payload) < 4 else "unsupported_version"]
        errors: list[str] = []
        try:
            return walk(payload, port, now, errors), errors
        except Malformed:
            return [], [*errors, "malformed"]

    def _domain(self, version: str, odid: int, now: float) -> Domain | None:
        """A domain of the device; where there are as many as may be, idle ones make room, or the new one is refused."""
        key = version, odid
        if key not in self.domains and len(self.domains) >= self.limits.domains:
            idle = [k for k, d in self.domains.items() if now - d.seen > self.limits.ttl]
            for k in idle:
                del self.domains[k]
            if not idle:
                self.refused["domains"] += 1
                return None
        domain = self.domains.setdefault(key, Domain())
        domain.seen = now
        return domain

    # -- NetFlow 9

    def _netflow9(self, payload: bytes, port: int, now: float, errors: list[str]) -> list[dict]:
        if len(payload) < 20:
            raise Malformed
        _, _, uptime, seconds, sequence, odid = unpack_from(">HHIIII", payload)
        domain = self._domain("netflow_v9", odid, now)
        if domain is None:
            errors.append("domain_limit")
            return []
        domain.packets.setdefault(port, PacketLoss()).see(sequence)
        clock = {"export_us": seconds * 1_000_000, "uptime": uptime}
        records: list[dict] = []
        at = 20
        while at + 4 <= len(payload):
            kind, size = unpack_from(">HH", payload, at)
            if size < 4 or at + size > len(payload):
                raise Malformed
            body = payload[at + 4 : at + size]
            at += size
            if kind in (0, 1):
                for layout_id, layout in (netflow9_layouts if kind == 0 else netflow9_options)(body, self.limits.fields):
                    self._announce(domain, port, layout_id, layout, now, errors)
            elif kind < 256:
                errors.append("reserved_set")
            elif (layout := self._layout(domain, port, kind, now)) is None:
                errors.append("missing_template")
            elif layout.variable:
                errors.append("invalid_template")
            elif len(body) < layout.least:
                errors.append("malformed")
            else:
                for i in range(len(body) // layout.least):
                    values, _ = split(layout, body, i * layout.least)
                    self._consume("netflow_v9", odid, domain, port, kind, layout, values, clock, records, now)
        return records

    # -- IPFIX

    def _ipfix(self, payload: bytes, port: int, now: float, errors: list[str]) -> list[dict]:
        if len(payload) < 16:
            raise Malformed
        _, size, seconds, sequence, odid = unpack_from(">HHIII", payload)
        if not 16 <= size <= len(payload):
            raise Malformed
        domain = self._domain("ipfix", odid, now)
        if domain is None:
            errors.append("domain_limit")
            return []
        message = payload[:size]
        if not self._whole(domain, port, message, now):
            raise Malformed
        clock = {"export_us": seconds * 1_000_000, "uptime": None}
        records: list[dict] = []
        seen, complete = 0, True
        for kind, body in sets(message, 16):
            if kind in (2, 3):
                for layout_id, layout in ipfix_layouts(body, kind == 3, self.limits.fields):
                    self._announce(domain, port, layout_id, layout, now, errors)
            elif kind < 256:
                errors.append("reserved_set")
                complete = False
            elif (layout := self._layout(domain, port, kind, now)) is None:
                errors.append("missing_template")
                complete = False
            else:
                at = 0
                while len(body) - at >= layout.least:
                    try:
                        values, at = split(layout, body, at)
                    except Malformed:
                        errors.append("malformed")
                        complete = False
                        break
                    seen += 1
                    self._consume("ipfix", odid, domain, port, kind, layout, values, clock, records, now)
        domain.records.setdefault(port, RecordLoss()).see(sequence, seen, 0, complete)
        return records

    def _whole(self, domain: Domain, port: int, message: bytes, now: float) -> bool:
        """Whether all lengths of a message add up. If not, the layouts that it redefines are withdrawn."""
        announced: dict[int, Layout | None] = {}
        good, at = True, 16
        while at + 4 <= len(message):
            kind, size = unpack_from(">HH", message, at)
            if size < 4 or at + size > len(message):
                good = False
                break
            body = message[at + 4 : at + size]
            at += size
            if kind in (2, 3):
                announced |= {i: x if x is not None and fits(x) else None for i, x in ipfix_layouts(body, kind == 3, self.limits.fields)}
            elif kind >= 256 and good:
                layout = announced[kind] if kind in announced else self._layout(domain, port, kind, now)
                good = layout is None or whole_records(layout, body)
        if not good:
            for i, layout in announced.items():
                held = domain.layouts.get((port, i))
                if held is not None and (layout is None or layout.elements != held.elements):
                    del domain.layouts[port, i]
        return good

    # -- both

    def _announce(self, domain: Domain, port: int, layout_id: int, layout: Layout | None, now: float, errors: list[str]) -> None:
        key = port, layout_id
        held = sum(len(x.elements) for d in self.domains.values() for x in d.layouts.values()) if layout is not None and key not in domain.layouts else 0
        full = key not in domain.layouts and (len(domain.layouts) >= self.limits.layouts or held + len(layout.elements if layout else ()) > self.limits.fields_held)
        self.refused["layouts"] += full
        if layout is None or not fits(layout) or full:
            errors.append("invalid_template")
            domain.layouts.pop(key, None)
            return
        layout.seen = now
        domain.layouts[key] = layout
        self.unread |= {(e.enterprise, e.number) for e in layout.elements if e.enterprise or e.number not in KNOWN}

    def _layout(self, domain: Domain, port: int, layout_id: int, now: float) -> Layout | None:
        layout = domain.layouts.get((port, layout_id))
        return layout if layout is not None and now - layout.seen <= self.limits.ttl else None

    def _consume(self, version: str, odid: int, domain: Domain, port: int, layout_id: int, layout: Layout, values: list, clock: dict, records: list[dict], now: float) -> None:
        if layout.options:
            self._learn(version, odid, port, layout, values, now)
        else:
            records.append(self._record(version, odid, domain, port, layout_id, read_fields(values), clock))

    def _record(self, version: str, odid: int, domain: Domain, port: int, layout_id: int, f: dict, clock: dict) -> dict:
        out = {"version": version, "odid": odid, "flows_reported": "flows" in f, "flows": f.get("flows", 1)}
        out |= {k: f[k] for k in ("protocol", "tos", "tcp_flags", "src_port", "dst_port", "src_mask", "dst_mask", "input_if", "output_if", "src_as", "dst_as", "direction", "app_id", "app_name") if k in f}
        for k in ("bytes", "packets"):
            if (n := f.get(k, f.get(f"out_{k}"))) is not None:
                out[k] = n
        out |= addresses(f)
        if f.get("frame") or f.get("ip"):
            if "src_addr" not in out and "dst_addr" not in out:
                out |= (packets.ethernet(f["frame"]) or {}) if f.get("frame") else packets.ip(f["ip"])
            out.setdefault("packets", 1)
            if f.get("frame_size"):
                out.setdefault("bytes", f["frame_size"])
        self._instants(out, f, clock, domain)
        scopes = [("template", odid, port, layout_id)] + ([("interface", odid, out["input_if"])] if out.get("input_if") else [])
        out["sampling_rate"], owed = self.samplers[version].resolve(odid, f.get("sampler"), f.get("selector"), scopes)
        domain.unresolved += owed
        if out.get("app_id") and "app_name" not in out:
            known = self.applications.get(out["app_id"], {})
            out |= {k: known[k] for k in ("app_name", "app_category") if k in known}
        return out

    @staticmethod
    def _instants(out: dict, f: dict, clock: dict, domain: Domain) -> None:
        if "start" in f and "end" in f:
            start, end = f["start"], f["end"]
        else:
            uptime = clock["uptime"]
            if uptime is None and "boot" in f:
                uptime = (clock["export_us"] - f["boot"]) // MS % WRAP
            if uptime is None or "first" not in f or "last" not in f:
                return
            start, end = (anchored(clock["export_us"], uptime, f[k]) for k in ("first", "last"))
        if end < start:
            domain.inversions += 1
        else:
            out["start_us"], out["end_us"] = start, end

    def _learn(self, version: str, odid: int, port: int, layout: Layout, values: list[tuple[Element, bytes]], now: float) -> None:
        said: dict = {}
        scope: dict = {}
        for i, (e, raw) in enumerate(values):
            if i < layout.scopes:
                known = V9_SCOPES if version == "netflow_v9" else IPFIX_SCOPES if not e.enterprise else {}
                if e.number in known:
                    kind, most = known[e.number]
                    scope[kind] = number(raw, most)
            if (e.enterprise, e.number) == PEN_CATEGORY:
                said["category"] = name(raw)
            elif e.enterprise:
                continue
            elif e.number in RATES:
                said[RATES[e.number]] = number(raw, 4) or 0
            elif e.number in (48, 302):
                said["sampler" if e.number == 48 else "selector"] = number(raw, 4)
            elif e.number == APPLICATION:
                said["app_id"] = application_id(raw)
            elif e.number == 96:
                said["app_name"] = name(raw)
                self.refused["strings"] += said["app_name"] is None and bool(raw.rstrip(b"\0 "))
        rate, table = declared_rate(said), self.samplers[version]
        if rate:
            sampler = said.get("sampler") if said.get("sampler") is not None else said.get("selector")
            if sampler is not None:
                table.declare(odid, sampler, rate)
            elif scope.get("template") is not None:
                table.declare_scope(("template", odid, port, scope["template"]), rate)
            elif scope.get("interface") is not None:
                table.declare_scope(("interface", odid, scope["interface"]), rate)
            elif scope.get("domain") is not None and scope["domain"] != odid:
                table.declare_scope(("domain", scope["domain"]), rate)
            else:
                table.declare(odid, None, rate)
        if not said.get("app_id"):
            return
        if now - self.announced > self.limits.ttl:  # names that no announcement renews go together
            self.applications.clear()
        self.announced = now
        if said["app_id"] not in self.applications and len(self.applications) >= self.limits.applications:
            self.refused["applications"] += 1
        else:
            known = self.applications.setdefault(said["app_id"], {})
            known |= {k: said[v] for k, v in (("app_name", "app_name"), ("app_category", "category")) if said.get(v)}


def declared_rate(said: dict) -> int:
    """Packets for each one sampled, from whichever way a device says it."""
    interval = said.get("interval", 0)
    if "space" in said and interval:
        return (interval + said["space"]) % WRAP // interval
    if said.get("size") and said.get("population"):
        return said["population"] // said["size"]
    return said.get("random") or said.get("plain", 0)


def fits(layout: Layout) -> bool:
    return 1 <= layout.least <= 0xFFFF - 4


def sets(message: bytes, at: int):
    while at + 4 <= len(message):
        kind, size = unpack_from(">HH", message, at)
        yield kind, message[at + 4 : at + size]
        at += size


def split(layout: Layout, body: bytes, at: int) -> tuple[list[tuple[Element, bytes]], int]:
    """Values of the record at a place, and the place behind it."""
    out = []
    for e in layout.elements:
        size = e.length
        if size == VARIABLE:
            if at >= len(body):
                raise Malformed
            size, at = body[at], at + 1
            if size == 255:
                if at + 2 > len(body):
                    raise Malformed
                size, at = unpack_from(">H", body, at)[0], at + 2
        if at + size > len(body):
            raise Malformed
        out.append((e, body[at : at + size]))
        at += size
    return out, at


def whole_records(layout: Layout, body: bytes) -> bool:
    if len(body) < layout.least:
        return False
    at = 0
    try:
        while layout.variable and len(body) - at >= layout.least:
            _, at = split(layout, body, at)
    except Malformed:
        return False
    return True


def _specs(body: bytes, at: int, n: int) -> list[Element]:
    return [Element(*unpack_from(">HH", body, at + 4 * i)) for i in range(n)]


def netflow9_layouts(body: bytes, most: int):
    """(id, layout or None if it is refused) of a template set."""
    at = 0
    while at + 4 <= len(body):
        layout_id, n = unpack_from(">HH", body, at)
        at += 4
        if not n:
            yield layout_id, None
            return
        end = at + 4 * n
        good = layout_id >= 256 and n <= most and end <= len(body)
        elements = _specs(body, at, n) if good else []
        yield layout_id, Layout(tuple(elements)) if good and all(e.length for e in elements) else None
        at = end


def netflow9_options(body: bytes, most: int):
    at = 0
    while at + 6 <= len(body):
        layout_id, scope_bytes, option_bytes = unpack_from(">HHH", body, at)
        at += 6
        scopes, n = scope_bytes // 4, scope_bytes // 4 + option_bytes // 4
        if scope_bytes % 4 or option_bytes % 4 or not n:
            yield layout_id, None
            return
        end = at + 4 * n
        good = layout_id >= 256 and n <= most and end <= len(body)
        elements = _specs(body, at, n) if good else []
        yield layout_id, Layout(tuple(elements), scopes, True) if good and all(e.length for e in elements[scopes:]) else None
        at = end


def ipfix_layouts(body: bytes, options: bool, most: int):
    at = 0
    while at + 4 <= len(body):
        layout_id, n = unpack_from(">HH", body, at)
        at += 4
        if not n:  # a withdrawal; layouts expire instead
            continue
        scopes = 0
        if options:
            if at + 2 > len(body):
                return
            scopes = unpack_from(">H", body, at)[0]
            at += 2
        good = layout_id >= 256 and n <= most and (not options or 1 <= scopes <= n)
        elements = []
        for _ in range(n):
            if at + 4 > len(body):
                good, at = False, len(body)
                break
            kind, length = unpack_from(">HH", body, at)
            at += 4
            enterprise = 0
            if kind & 0x8000:
                if at + 4 > len(body):
                    good, at = False, len(body)
                    break
                enterprise = unpack_from(">I", body, at)[0]
                at += 4
            good = good and length > 0
            elements.append(Element(kind & 0x7FFF, length, enterprise))
        yield layout_id, Layout(tuple(elements), scopes, options) if good else None
