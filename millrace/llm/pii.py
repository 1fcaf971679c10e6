"""Personal data: plain detection, and detection behind disguises with offsets mapped back to the source.

Transducers rewrite a text: look-alike letters and foreign digits become ASCII, invisible characters vanish, "(at)",
"dot" and spelled digits become the characters they stand for. A rewritten text is a list of stretches, each copied or
replaced, so that a span found in it maps back to the source.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import strings
from .storage import named, numbered, prepare

KINDS = ("email", "ip", "card", "phone")

# Letters that look like ASCII ones, spelled digits, endings known as such, determiners of English,
# invisible characters.
LOOK_ALIKES = dict(
    zip("АВЕЅІЈКМНОРСТХаеіјорсухѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναɡ․﹒。＠﹫", "ABESIJKMHOPCTXaeijopcyxsdqwhABEZHIKMNOPTYXovag...@@", strict=True)
)
SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
ENDINGS = "com org net edu gov mil info biz io co ai dev app eu uk ca au fr nl ch pl ru jp cn br example".split()
DETERMINERS = ("the", "a", "an", "this", "that", "each", "every", "any", "no", "my", "your", "his", "her", "its", "our", "their")
# Fixed values of English: words that go on with a sentence after a "dot", and words before "at" that aren't mailboxes.
GOING_ON = "i we you he she it they and or but so then than when if is are was were be to in on of for with go now not as at by from there here".split()
NO_MAILBOX = (
    "us me him her them it you more look looks looked looking see visit available found find here there online hosted based located is are was were be been being read live all up only "
    "order page site sites website web posted published shop stop join meet start starts listed information info details documentation docs docs blog code home register sign"
).split()
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

_WORDS = "|".join(SPELLED)
_WORD = f"(?a:{_WORDS})"  # else ignoring case lets other letters stand for s and i
_KNOWN = "|".join(ENDINGS)
#: A spelled domain: any ending of letters after a spelled dot will do, unless the words before are plain prose
#: ("at the dot now") or the ending is a digit ("at seven dot five").
_SPELLED_DOMAIN = (
    rf"(?!(?:{'|'.join(DETERMINERS)})\b)(?:[\w-]+(?:[ \t]+dot[ \t]+[\w-]+)*[ \t]+dot[ \t]+(?:{_KNOWN})\b"
    rf"|[\w-]+(?:[ \t]+dot[ \t]+[\w-]+)*[ \t]+dot[ \t]+(?!(?:{_WORD}|{'|'.join(GOING_ON)})\b)[a-z]{{2,24}}\b)"
)
#: The blanks before a bracket are taken when it has matched, so that a run of blanks is read once.
_REWRITE = re.compile(
    rf"(?P<gone>[{INVISIBLE}]+)"
    r"|(?P<at>[\[({<][ \t]*at[ \t]*[\])}>][ \t]*"
    rf"|(?<=\w)[ \t]+at[ \t]+(?={_SPELLED_DOMAIN}|[\w-]+[ \t]*[\[({{<][ \t]*dot)"
    rf"|(?<=[a-z0-9])(?:_at_(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{_KNOWN})\b)|(?P<s>[_-])at(?P=s)(?=[a-z0-9]+(?:(?P=s)dot(?P=s)[a-z0-9]+)*(?P=s)dot(?P=s)[a-z]{{2,24}}\b))"
    r"|&(?:\#0{0,8}64|\#x0{0,8}40|commat);"
    rf"|(?<=\w)[ \t]+(?P<near>at)[ \t]+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{_KNOWN})\b)"
    r"|(?<=\w)[ \t]+-[ \t]?at[ \t]?-[ \t]*(?=\w)|(?<=\w)[ \t]+@[ \t]+(?=\w))"
    r"|(?P<dot>[\[({<][ \t]*dot[ \t]*[\])}>][ \t]*|(?<=\w)[ \t]+dot[ \t]+(?=\w)|(?<=[a-z0-9])(?P<z>[_-])dot(?P=z)(?=[a-z0-9])|&(?:\#0{0,8}46|\#x0{0,8}2e|period);"
    rf"|(?<=\w)[ \t]+-[ \t]?dot[ \t]?-[ \t]*(?=\w)|(?<=\w)[ \t]+\.[ \t]+(?=(?:{_KNOWN})\b))"
    rf"|(?P<plus>\bplus[ \t]+(?={_WORD}\b|[0-9]))"
    rf"|(?P<digits>\b{_WORD}(?:[ -]{_WORD})*\b)",
    re.I,
)


_AT = re.compile(rf"[\[({{<][ \t]*at|[a-z0-9]_at_|&(?:\#|commat|period)|[ \t](?:-[ \t]?at[ \t]?-|@[ \t]|at[ \t]+[a-z0-9-]+\.|\.[ \t]+(?:{_KNOWN})\b)", re.I)
_LAST = re.compile(r"[a-z0-9._%+-]+\Z", re.I)
_PLUS = re.compile(rf"\bplus[ \t]+(?:{_WORD}\b|[0-9])", re.I)
_SPELLED = re.compile(_WORDS)
_BESIDE = re.compile(rf"(?:{_WORDS})[ .-](?:{_WORDS}|[0-9])")
_BEHIND = re.compile(rf"[0-9][ .-](?:{_WORDS})")


def _one_to_one() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    return table | {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x11000) if unicodedata.decimal(chr(c), None) is not None}


_TABLE = _one_to_one()
_STRANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_TABLE)) + INVISIBLE + "]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time: from each @ outwards."""
    if (at := text.find("@")) < 0:
        return []
    found, free, back, n = [], 0, text[::-1], len(text)
    while at >= 0:
        local = _LOCAL.match(back, n - at)
        start = max(free, at - len(local[0])) if local else at
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind; matches that fail their test are dropped and not tried again."""
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not _ANY_DIGIT.search(text):
        return out
    small = lambda part: len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NON_DIGIT.sub("", m[0])) <= 15]
    return out


def disguised(text: str) -> bool:
    """Whether rewriting the text can give other spans: tests that follow from each alternative of ``_REWRITE``.

    ``at`` needs a bracket, a dash or a low line before it, or a domain or ``dot`` after it, ``@`` and a dot that are set
    apart need blanks on both sides, and a character reference its ``&``. A spelled digit alters cards, addresses of hosts and mail only
    beside another digit, spelled or not, and phones only after a plus; alone it stands for a character of the same class.
    """
    if not text.isascii() and _STRANGE.search(text):
        return True
    low = text.lower()
    if "dot" in low or _AT.search(text) or "plus" in low and _PLUS.search(text):
        return True
    return bool(_SPELLED.search(low) if "+" in low else _BESIDE.search(low) or _BEHIND.search(low))


class Rewritten:
    """A rewritten text and its stretches."""

    def __init__(self, source: str):
        even = source.translate(_TABLE)
        parts, self.starts, self.origins, at, length = [], [], [], 0, 0

        def stretch(piece: str, lo: int, hi: int, copied: bool) -> None:
            nonlocal length
            if piece:
                self.starts.append(length)
                self.origins.append((lo, hi, copied))
                parts.append(piece)
                length += len(piece)

        for m in _REWRITE.finditer(even):
            low = m.start()
            if m["near"]:  # "read more at example.com"
                before = _LAST.search(even, max(0, low - 64), low)
                if not before or before[0].lower().strip(".-") in NO_MAILBOX:
                    continue
            if m["at"] or m["dot"]:
                while low > at and even[low - 1] in " \t":
                    low -= 1
            stretch(even[at:low], at, low, True)
            piece = next(p for k, p in (("gone", ""), ("at", "@"), ("dot", "."), ("plus", "+"), ("digits", None)) if m[k] is not None)
            if piece is None:
                piece = "".join(SPELLED[w.lower()] for w in re.split("[ -]", m[0]))
            stretch(piece, low, m.end(), False)
            at = m.end()
        stretch(even[at:], at, len(even), True)
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a span; it takes in the whole of what was replaced."""
        i, j = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_right(self.starts, end - 1) - 1
        (lo, _, a), (lo2, hi2, b) = self.origins[i], self.origins[j]
        return lo + (start - self.starts[i]) * a, lo2 + end - self.starts[j] if b else hi2


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and all spans by kind, as code points of the source.

    Added spans are those of the rewritten text that, mapped back, don't lie inside a base span nor overlap a base
    span of another kind.
    """
    base = plain_spans(text)
    if not disguised(text):
        return base, base
    new = Rewritten(text)
    taken = [(s, k) for k, spans in base.items() for s in spans]
    every = {}
    for kind, spans in plain_spans(new.text).items():
        mapped = {new.back(*s) for s in spans}
        added = {s for s in mapped if not any(s[0] < b[1] and b[0] < s[1] and (k != kind or (b[0] <= s[0] and s[1] <= b[1])) for b, k in taken)}
        every[kind] = sorted({*base[kind], *added})
    return base, every


def listing(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Replaces spans by ``[KIND]``; overlapping ones become one, named by the first."""
    out, at = [], 0
    for s, e, k in sorted((s, -e, KINDS.index(k)) for k in KINDS for s, e in spans[k]):
        s, e = max(s, at), -e
        if e > at:
            if s > at or not out or s == 0:
                out.append(text[at:s])
                out.append(f"[{KINDS[k].upper()}]")
            at = e
    return "".join(out) + text[at:]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id, n_email, n_ip, n_card, n_phone`` (all spans), ``base_sha256``, ``spans`` and ``redacted``.

    A null text counts as empty: no spans, an empty listing, an empty redacted text. Rows with null or equal ids each
    give a row; other columns are left out.
    """

    def run(batches):
        for b in batches:
            counts, base_sha, spans, redacted = [], [], [], []
            for t in strings(b.column(1)):
                base, every = find(t)
                counts.append([len(every[k]) for k in KINDS])
                base_sha.append(sha256(listing(base).encode()).hexdigest())
                spans.append(listing(every))
                redacted.append(redact(t, every) if spans[-1] else t)
            numbers = [pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            yield pa.record_batch(
                [b.column(0), *numbers, pa.array(base_sha, pa.string()), pa.array(spans, pa.string()), pa.array(redacted, pa.string())],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"],
            )

    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    )


def scrub(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with all spans of its texts replaced by their kind in brackets, and ``length_col`` set to the new number of
    code points. Null texts and their lengths stay as they are; all rows and other columns stay."""
    at = df.columns.index(text_col)
    length = df.columns.index(length_col) if length_col in df.columns else None
    df_columns = df.columns

    def run(batches):
        for b in batches:
            texts = [t and redact(t, find(t)[1]) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], columns[length].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, names=df_columns)

    prepare(df.sparkSession)
    return numbered(df).mapInArrow(run, df.schema)
