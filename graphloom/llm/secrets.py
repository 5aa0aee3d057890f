"""Secret scans with multipart credential linking.

Strong parts (assignments to secret names, access key identifiers, long hex runs) are reported wherever they stand. Weak
parts (user or client identifiers, endpoints, random-looking keys) say little alone: they are joined as intervals with
complementary parts in the same scope, and reported only if linked. A scope is a stretch of text between blank lines. In
a scope of several lines all parts link; in one running line, two link if no more than `reach` code points lie between them. Complementary are identifier and secret, endpoint and
secret other than a bare hex run, and an endpoint or identifier with a random-looking key, which then counts as a secret; a key that is a value in
an endpoint's own query links with it.

Texts are scanned whole. Every pattern takes time linear in the text, the join sorts a document's own parts and sweeps them.

Defined results: a null or empty text has no spans; spans count code points, ends are exclusive; equal weak parts at other
places are judged each for itself; a weak part that overlaps a strong one is dropped; repeated rows are scanned each for
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
STRONG = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones fail alike
_IDENT = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:[_-]?(?:name|id))?|login|client[_-]?id|access[_-]?key(?:[_-]?id)?|account[_-]?(?:id|name|key)|tenant[_-]?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20\"'<>\x7f]{3,}")
_HOST = re.compile(r"""(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{1,253}(?::[0-9]{1,5})?)""", re.I | re.A)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}+(?![A-Za-z0-9+/_-]))?")  # a "=" before a value is no padding
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, ordered by start, then kind."""
    out = []
    low = text.lower()  # tells only whether to look; places come from the text itself
    if any(x in low for x in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def looks_random(word: str) -> bool:
    """Upper and lower case, digits, and at least 3.5 bits a character."""
    if not (any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)):
        return False
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= 3.5


def linked_spans(text: str, strong: list[tuple[str, int, int]], reach: int = 300) -> list[tuple[str, int, int]]:
    """The weak spans that have a complementary part in their scope; `reach` bounds scopes of a single line."""
    idents, endpoints = [], []
    if ":" in text or "=" in text:
        idents = [("ident", *m.span()) for m in _IDENT.finditer(text)]
        endpoints = [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
        endpoints += [("endpoint", *m.span()) for m in _HOST.finditer(text)]
    access = [s for s in strong if s[0] == "access"]
    if not (idents or endpoints or access):
        return []
    keys = [("key", *m.span()) for m in _KEY.finditer(text) if looks_random(m[0])]
    secrets = [s for s in strong if s[0] != "access"] + keys
    # one list of strong starts and of running ends answers overlap; spans of a kind don't nest
    taken = sorted((s[1], s[2]) for s in strong)
    starts, ends = [s[0] for s in taken], []
    for s in taken:
        ends.append(max(s[1], ends[-1] if ends else 0))

    def free(s) -> bool:
        k = bisect_left(starts, s[2])
        return not k or ends[k - 1] <= s[1]

    blanks = [m.span() for m in _BLANK.finditer(text)]
    breaks = [a for a, _ in blanks]
    lines: dict[int, bool] = {}

    def block(k: int) -> bool:
        """Whether scope k, before blank k, has several lines."""
        if k not in lines:
            lines[k] = "\n" in text[blanks[k - 1][1] if k else 0 : breaks[k] if k < len(breaks) else len(text)].strip()
        return lines[k]

    found = []
    named = [s for s in secrets if s[0] != "hex"]  # a digest near an address is no credential
    for part, others in ((idents, secrets), (endpoints, named), (keys, idents + endpoints + access)):
        others = sorted((o[1], o[2]) for o in others)
        first, last = [o[0] for o in others], sorted(o[1] for o in others)
        for s in part:
            k = bisect_left(breaks, s[1])
            low, high = breaks[k - 1] if k else 0, breaks[k] if k < len(breaks) else len(text)
            if not block(k):
                low, high = max(s[1] - reach, low), min(s[2] + reach, high)
            # some interval ends in [low, start] or starts in [end, high]: parts may touch, not overlap
            before = bisect_right(last, s[1]) > bisect_left(last, low)
            after = bisect_right(first, high) > bisect_left(first, s[2])
            if (before or after) and free(s):
                found.append(s)
    # a key as a value in the query of an endpoint lies within its complement
    inner = [s[1] for s in keys]
    for e in endpoints:
        query = text.find("?", e[1], e[2])
        for s in keys[bisect_left(inner, query) : bisect_left(inner, e[2])] if query >= 0 else ():
            if s[2] <= e[2] and text[s[1] - 1] == "=":
                found += [x for x in (e, s) if free(x)]
    return list(dict.fromkeys(found))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(column: pa.Array) -> list[pa.Array]:
    counts: list[list[int]] = [[], [], []]
    digests, spans = [], []
    for text in column.to_pylist():
        text = text or ""
        strong = strong_spans(text)
        for c, kind in zip(counts, STRONG, strict=True):
            c.append(sum(s[0] == kind for s in strong))
        digests.append(hashlib.sha256(joined(strong).encode()).hexdigest())
        spans.append(joined(ordered(strong + linked_spans(text, strong))))
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]


def scan_secrets(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns `carry` with counts, the digest of the base spans and all spans of each text."""
    return map_texts(docs, scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", carry)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
