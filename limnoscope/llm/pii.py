"""Personal data in texts: anchors found by one automaton, each grown by a small parser into a validated span.

One Aho-Corasick pass over a text finds what every kind of span must hold: an at-sign
(or its bracketed spelling), a plus, a scheme's ``://``, a digit, or an identifier cue
such as ``iban``. At an anchor a deterministic parser looks left and right for the
span's borders and checks it (label structure, number range, digit count, Luhn or
mod-97 sum). Parsers of one kind remember where their last span ended, so each text
is read a bounded number of times whatever it holds.

Base kinds follow fixed patterns, leftmost and without overlap per kind:

========  ===================================================================
email     ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
ip        ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
card      ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass Luhn
phone     ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits
========  ===================================================================

Beyond these the anchors add emails spelled ``name (at) host (dot) org``, phone numbers
without a plus after a cue (``tel: 030 1234567``), addresses with a scheme (``url``) and
bank accounts (``account``: an IBAN or a number after a cue). An added span never
overlaps a span of its own kind.

Null and empty texts have no spans. Positions are code points, ends exclusive. Rows
stay as they are (ties and repeated rows alike); an input column with the name of the
result column is replaced. Nothing is shuffled; a task holds one Arrow batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnoscope.llm.common import lower_ascii

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE_TAIL = re.compile(r"[0-9][ ().0-9-]+")
_LOCAL_PHONE = re.compile(r"[ \t]*(?:no\.?|nr\.?|number)?[ \t]*[:=#][ \t]*(\(?[0-9][ ().0-9/-]*[0-9])", re.IGNORECASE)
_SPELLED_HOST = re.compile(r"[ \t]*([A-Za-z0-9-]+(?:(?:[ \t]*[(\[{](?:dot)[)\]}][ \t]*|\.)[A-Za-z0-9-]+)+)", re.IGNORECASE)
_URL_TAIL = re.compile(r"[^\s<>\"'`|\\^{}]+")
_HOST = re.compile(r"(?:[^@/?#]*@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?=[/?#]|$)")
_IBAN = re.compile(r"[ \t]*[:=#]?[ \t]*([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
_ACCOUNT = re.compile(r"[ \t]*(?:no\.?|nr\.?|number)?[ \t]*[:=#][ \t]*([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)

PHONE_CUES = ("tel", "telephone", "phone", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono")
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta")
SPELLED_AT = ("(at)", "[at]", "{at}")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    words = {"@": "at", "+": "plus", "://": "scheme", "iban": "iban"}
    words |= {str(d): "digit" for d in range(10)}
    words |= {cue: "phone" for cue in PHONE_CUES} | {cue: "account" for cue in ACCOUNT_CUES}
    words |= {at: "spelled" for at in SPELLED_AT}
    for word, role in words.items():
        found.add_word(word, (role, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Whether the mod-97 check of an account number in international form holds."""
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class Finder:
    """Spans of one text after another; the automaton is built once per worker."""

    def __init__(self):
        self.automaton = _automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """(start, rank of the kind, end, base) of all spans, sorted."""
        if not text:
            return []
        base: list[list[tuple[int, int]]] = [[], [], [], []]
        extra: list[tuple[int, int, int]] = []
        email_from = ip_from = card_from = url_from = 0
        lower = lower_ascii(text)
        for last, (role, size) in self.automaton.iter(lower):
            at = last - size + 1
            if role == "digit":
                if at >= card_from:
                    end = _DIGITS.match(text, at).end()
                    card_from = end
                    if end - at >= 14:
                        number = _digits(text[at:end])
                        if 14 <= len(number) <= 19 and luhn(number):
                            base[2].append((at, end))
                if at >= ip_from:
                    chain = _DOTTED.match(text, at)
                    ip_from = chain.end()
                    self._addresses(chain.group(), at, base[1])
            elif role == "at":
                start = at
                while start > email_from and text[start - 1] in _LOCAL:
                    start -= 1
                domain = _DOMAIN.match(text, at + 1) if start < at else None
                if domain:
                    email_from = domain.end()
                    base[0].append((start, email_from))
            elif role == "plus":
                tail = _PHONE_TAIL.match(text, at + 1)
                if tail:
                    run = tail.group().rstrip(" ().-")
                    if len(run) >= 3 and 10 <= len(_digits(run)) <= 15:
                        base[3].append((at, at + 1 + len(run)))
            elif role == "scheme":
                if at >= url_from:
                    url_from = self._url(text, at, extra)
            elif role == "spelled":
                self._spelled(text, at, last + 1, extra)
            elif (at == 0 or lower[at - 1] not in _WORD) and (last + 1 == len(lower) or lower[last + 1] not in _WORD):
                self._cue(text, role, last + 1, extra)
        out = [(s, kind, e, True) for kind, found in enumerate(base) for s, e in found]
        return sorted(out + self._apart(extra, out)) if extra else sorted(out)

    @staticmethod
    def _addresses(chain: str, at: int, into: list[tuple[int, int]]) -> None:
        """Groups of four numbers of a dotted chain, from its start."""
        if chain.count(".") < 3:
            return
        parts = chain.split(".")
        for g in range(0, len(parts) - 3, 4):
            four = parts[g:g + 4]
            size = sum(map(len, four)) + 3
            # Leading zeros may make a part long; its value counts.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                into.append((at, at + size))
            at += size + 1

    @staticmethod
    def _url(text: str, at: int, into: list) -> int:
        """Adds the address around a ``://``; returns where the next one may begin."""
        start = at
        while start and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        tail = _URL_TAIL.match(text, at + 3)
        if start < at and tail:
            rest = tail.group().rstrip(".,;:!?)]")
            if _HOST.match(rest):
                into.append((start, 4, at + 3 + len(rest)))
        return tail.end() if tail else at

    @staticmethod
    def _spelled(text: str, at: int, after: int, into: list) -> None:
        stop = at
        while stop and text[stop - 1] in " \t":
            stop -= 1
        start = stop
        while start and text[start - 1] in _LOCAL:
            start -= 1
        host = _SPELLED_HOST.match(text, after)
        if start < stop and host:
            into.append((start, 0, host.end(1)))

    @staticmethod
    def _cue(text: str, role: str, after: int, into: list) -> None:
        if role == "phone":
            found = _LOCAL_PHONE.match(text, after)
            if found and 7 <= len(_digits(found.group(1))) <= 15:
                into.append((found.start(1), 3, found.end(1)))
        elif role == "account":
            found = _ACCOUNT.match(text, after)
            if found:
                into.append((found.start(1), 5, found.end(1)))
        elif role == "iban":
            found = _IBAN.match(text, after)
            # The longest prefix that passes: a word after the number may look like a part of it.
            end = found.end(1) if found else 0
            while found and end - found.start(1) >= 15:
                if text[end - 1] != " " and iban_valid(text[found.start(1):end]):
                    into.append((found.start(1), 5, end))
                    break
                end -= 1

    @staticmethod
    def _apart(extra: list, base: list) -> list:
        """Added spans that overlap no span of their kind, base ones first, then from the left."""
        out, taken = [], {}
        for s, kind, e, _ in base:
            taken.setdefault(kind, []).append((s, e))
        for s, kind, e in sorted(extra):
            held = taken.setdefault(kind, [])
            i = bisect_left(held, (s, s))
            if (i == len(held) or held[i][0] >= e) and (i == 0 or held[i - 1][1] <= s):
                insort(held, (s, e))
                out.append((s, kind, e, False))
        return out


_finder: list[Finder] = []


def _shared() -> Finder:
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def personal_spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """``docs`` with the column ``into``: all spans of each whole text, by start, then kind as in ``KINDS``."""
    at = docs.columns.index(text)
    kept = [i for i, name in enumerate(docs.columns) if name.lower() != into.lower()]
    fields = [*(docs.schema[i] for i in kept), T.StructField(into, T._parse_datatype_string(SPANS))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _shared()
        for batch in batches:
            # Row by row: a long text is one Python string at a time.
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in finder.spans(t.as_py())]
                    for t in batch.column(at)]
            columns = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _SPANS_ARROW)], [f.name for f in fields])

    return docs.mapInArrow(find, T.StructType(fields))


def redact(docs: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """``docs`` with each personal span of ``text`` replaced by its kind in capitals, as ``[EMAIL]``.

    Where spans of several kinds overlap, their union gives way to the mask of the first.
    """
    at = docs.columns.index(text)
    names = docs.columns

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _shared()
        for batch in batches:
            out = []
            for value in batch.column(at):
                whole = value.as_py()
                parts, done = [], 0
                for s, kind, e, _ in finder.spans(whole):
                    if s >= done:
                        parts += [whole[done:s], mask.format(KINDS[kind].upper())]
                    done = max(done, e)
                out.append(None if whole is None else "".join(parts) + whole[done:])
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(hide, docs.schema)


def digest_columns(spans: str = "pii_spans") -> dict:
    """Counts and digest of the base spans, and all spans as text, as columns over a span column."""
    base = F.filter(spans, lambda s: s["base"])

    def joined(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    out = {f"n_{kind}": count(kind) for kind in BASE_KINDS}
    return out | {"base_sha256": F.sha2(joined(base).cast("binary"), 256), "spans": joined(F.col(spans))}
