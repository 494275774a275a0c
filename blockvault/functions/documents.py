"""Documents that are built from items: mails, events, contacts, list rows, chat pages."""

from __future__ import annotations

import base64
import email
import email.policy
import html
import json
import quopri
import re
from collections.abc import Mapping
from datetime import UTC, date, datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CorruptData

#: The header that marks a part whose body was taken out: a fixed value of the format.
PART_HEADER = "X-ABL-ID"


_MARKED = re.compile(rb"(?im)^" + PART_HEADER.encode() + rb":[ \t]*([^\r\n]*?)[ \t]*\r?\n")
_ENCODING = re.compile(rb"(?im)^Content-Transfer-Encoding:[ \t]*([-\w]+)")
_ENCODERS = {b"base64": base64.encodebytes, b"quoted-printable": quopri.encodestring}


def build_eml(skeleton: bytes, fragments: Mapping[str, bytes]) -> bytes:
    """A mail from its skeleton and the bodies of its parts, matched by the id in the part's header, never by place.

    The skeleton's bytes stay as they are but for that header, which goes, and the body behind the part's blank line,
    which is encoded as the part says.  A part whose id has no fragment stays as it is.
    """
    out, at = [], 0
    for mark in _MARKED.finditer(skeleton):
        body = fragments.get(mark[1].decode("utf-8", "replace"))
        if body is None or mark.start() < at:
            continue
        blank = re.compile(rb"\r?\n(\r?\n|\Z)").search(skeleton, mark.end() - 2)
        if blank is None:
            continue
        head = max(skeleton.rfind(b"\n--", 0, mark.start()), 0)
        encoding = _ENCODING.search(skeleton, head, blank.end())
        end = skeleton.find(b"\n--", blank.end() - 1)
        end = len(skeleton) if end < 0 else end - (skeleton[end - 1 : end] == b"\r")
        encoded = _ENCODERS.get(encoding[1].lower() if encoding else b"", bytes)(body)
        out += [skeleton[at : mark.start()], skeleton[mark.end() : blank.end()], encoded, b"\r\n" if encoded[-1:] != b"\n" and skeleton[end:].startswith(b"\n") else b""]
        at = max(end, blank.end())
    return b"".join([*out, skeleton[at:]])


@F.pandas_udf(T.BinaryType())
def eml(skeleton: pd.Series, ids: pd.Series, bodies: pd.Series) -> pd.Series:
    """Mails from skeletons and parallel arrays of fragment ids and bodies."""
    rows = zip(skeleton, ids, bodies, strict=True)
    return pd.Series([None if s is None else build_eml(s, dict(zip(() if i is None else i, () if b is None else map(bytes, b), strict=True))) for s, i, b in rows], dtype=object)


# -- events ----------------------------------------------------------------------------------------------------


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\r\n", "\\n").replace("\n", "\\n")


def _fold(line: str) -> str:
    """Lines of at most 75 bytes, continued after a blank."""
    raw, out = line.encode(), []
    while len(raw) > 75:
        at = 75 if not out else 74
        while raw[at] & 0xC0 == 0x80:
            at -= 1
        out.append(raw[:at].decode())
        raw = raw[at:]
    return "\r\n ".join([*out, raw.decode()])


def _when(value: object) -> tuple[str, str] | None:
    """(parameters, value) of a date or time of an event."""
    if not isinstance(value, Mapping):
        return None
    if day := value.get("date"):
        return ";VALUE=DATE", date.fromisoformat(day).strftime("%Y%m%d")
    if not (text := value.get("dateTime")):
        return None
    at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", str(text)))
    zone = value.get("timeZone")
    if at.tzinfo is None and zone not in (None, "", "UTC"):
        return f";TZID={zone}", at.strftime("%Y%m%dT%H%M%S")
    return "", (at.astimezone(UTC) if at.tzinfo else at).strftime("%Y%m%dT%H%M%SZ")


def build_ics(metadata: bytes, event_id: str) -> bytes:
    """One event as iCalendar, from the metadata of either family of services; raw XML is refused."""
    try:
        item = json.loads(metadata)
    except ValueError as e:
        raise CorruptData("event metadata") from e
    item = item.get("client_metadata", item) if isinstance(item, dict) else None
    if not isinstance(item, dict):
        raise CorruptData("event metadata")
    if "RawXML" in item:
        raise CorruptData("event as raw XML")
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//blockvault//EN", "BEGIN:VEVENT", f"UID:{_escape(str(item.get('iCalUId') or item.get('iCalUID') or event_id))}"]
    for name, key in (("DTSTART", "start"), ("DTEND", "end")):
        if when := _when(item.get(key)):
            lines.append(f"{name}{when[0]}:{when[1]}")
    body = item.get("body")
    texts = {"SUMMARY": item.get("subject") or item.get("summary"), "DESCRIPTION": body.get("content") if isinstance(body, dict) else item.get("description")}
    place = item.get("location")
    texts["LOCATION"] = place.get("displayName") if isinstance(place, dict) else place
    lines += [f"{k}:{_escape(str(v))}" for k, v in texts.items() if v]
    who = item.get("organizer")
    who = who.get("emailAddress", who) if isinstance(who, dict) else {}
    if mail := who.get("address") or who.get("email"):
        name = who.get("name") or who.get("displayName")
        lines.append(f'ORGANIZER{f";CN={json.dumps(name, ensure_ascii=False)}" if name else ""}:mailto:{mail}')
    for guest in item.get("attendees") or ():
        address = guest.get("emailAddress", guest) if isinstance(guest, dict) else {}
        if mail := address.get("address") or address.get("email"):
            lines.append(f"ATTENDEE:mailto:{mail}")
    for rule in item.get("recurrence") if isinstance(item.get("recurrence"), list) else ():
        if isinstance(rule, str) and rule.startswith(("RRULE:", "EXDATE", "RDATE", "EXRULE")):
            lines.append(rule)
    lines += ["END:VEVENT", "END:VCALENDAR", ""]
    return "\r\n".join(map(_fold, lines)).encode()


@F.pandas_udf(T.BinaryType())
def ics(metadata: pd.Series, event_id: pd.Series) -> pd.Series:
    """Events as iCalendar; null where the metadata is corrupt or refused."""
    out = []
    for raw, ident in zip(metadata, event_id, strict=True):
        try:
            out.append(None if raw is None else build_ics(raw, str(ident)))
        except (CorruptData, ValueError):
            out.append(None)
    return pd.Series(out, dtype=object)


# -- contacts and list rows ------------------------------------------------------------------------------------

#: Columns of the contact file that mail programs import, and the paths in the metadata's client part for them: fixed values.
CONTACT_COLUMNS = (
    ("First Name", "givenName"), ("Middle Name", "middleName"), ("Last Name", "surname"), ("E-mail Address", "emailAddresses[0].address"), ("Business Phone", "businessPhones[0]"),
    ("Home Phone", "homePhones[0]"), ("Mobile Phone", "mobilePhone"), ("Job Title", "jobTitle"), ("Company", "companyName"), ("Business Street", "businessAddress.street"),
    ("Business City", "businessAddress.city"), ("Business State", "businessAddress.state"), ("Business Postal Code", "businessAddress.postalCode"),
    ("Business Country/Region", "businessAddress.countryOrRegion"), ("Notes", "personalNotes"),
)


def contact_csv(metadata: Column) -> Column:
    """A contact, from its object's metadata, as a file of two rows: byte order mark, all fields quoted, CRLF; missing
    fields are empty."""
    quote = lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    head = ",".join(f'"{name}"' for name, _ in CONTACT_COLUMNS)
    row = F.concat_ws(",", *[quote(F.get_json_object(metadata, f"$.client_metadata.{path}")) for _, path in CONTACT_COLUMNS])
    return F.concat(F.lit("\ufeff" + head + "\r\n"), row, F.lit("\r\n"))


def values_json(values: Column) -> Column:
    """A list row's field values, a map, as JSON."""
    return F.to_json(values)


# -- chats -----------------------------------------------------------------------------------------------------

_KEPT = {"a", "b", "blockquote", "br", "code", "div", "em", "i", "li", "ol", "p", "pre", "s", "span", "strong", "table", "tbody", "td", "th", "thead", "tr", "u", "ul", "img", "h1", "h2", "h3"}
_VOID = {"br", "img"}
_DROPPED = {"script", "style", "iframe", "object"}


class _Sanitizer(HTMLParser):
    def __init__(self, stickers: Mapping[str, str]):
        super().__init__(convert_charrefs=True)
        self.stickers, self.out, self.open, self.skipped = stickers, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROPPED:
            self.skipped += 1
        if self.skipped or tag not in _KEPT:
            return
        found = dict(attrs)
        kept = ""
        if tag == "a" and re.match(r"(https?:|mailto:)", (found.get("href") or "").strip(), re.I):
            kept = f' href="{html.escape(found["href"].strip())}"'
        if tag == "img":
            inline = self.stickers.get(found.get("src") or "")
            if inline is None:
                self.out.append(html.escape(f"[{found.get('alt') or 'image'}]"))
                return
            kept = f' src="data:image/png;base64,{html.escape(inline)}"'
        self.out.append(f"<{tag}{kept}>")
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.skipped = max(0, self.skipped - 1)
        if not self.skipped and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(html.escape(data, quote=False))


def sanitize(raw: str | None, stickers: Mapping[str, str] | None = None) -> str:
    """A message body with known harmless markup only; images only as inline stickers; all elements closed."""
    parser = _Sanitizer(stickers or {})
    parser.feed(raw or "")
    parser.close()
    return "".join(parser.out + [f"</{t}>" for t in reversed(parser.open)])


@F.pandas_udf(T.StringType())
def sanitized(raw: pd.Series) -> pd.Series:
    return raw.map(sanitize)


def avatar_color(name: Column, colors: int = 8) -> Column:
    """One of a few colours: the sum of the name's code points modulo their number."""
    return F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c)) % colors
