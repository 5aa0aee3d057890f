"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans: email, ip, card, phone. The field labels the tokens of a document O, NAME, ID or CONTACT:
unary potentials from a token's shape and cue words before it, chain potentials between neighbours, and skip potentials
between tokens with the same or a similar form wherever they stand, so that a name met beside its title is also found
later without one, and a part of an address found by a pattern elsewhere too. Loopy sum-product messages, damped, run over
the whole document's graph. Weights are learned by pseudo-likelihood on sentences made by a rule in this module.

The graph holds every token in three places of a cue, found by a pattern, with a shape that has weight for another label
than O, or of the same form as one of these; neighbours outside act as observed O. Occurrences of a form are linked through
one node, which tells each of them what the other with the strongest evidence says: every one sees the cue, however many
stand between, and edges grow with the tokens.

Defined results: a null or empty text has no spans; spans count code points, ends are exclusive; spans of the field that
overlap base spans are dropped; repeated rows are read each for itself; an empty table gives no rows; very long texts are
read whole in time linear in them; extra columns are kept or ignored as the caller asks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, unused

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "id", "contact")
LABELS = ("O", "NAME", "ID", "CONTACT")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a run that fails at its start fails everywhere in it
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, told from each @: its local part is the run before it, as far as the last match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 or not p.lstrip("0") or int(p.lstrip("0")[:4]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


# Cue words before personal data, by label, in the corpus' languages.
NAME_CUES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme mlle señor señora sra name nom nombre vorname nachname surname firstname lastname dear".split())
ID_CUES = frozenset("ssn iban passport account acct konto kontonummer compte cuenta pasaporte passeport reisepass ausweis taxid nif dni nss vat patient customer kundennummer".split())
CONTACT_CUES = frozenset("email e-mail mail phone tel telephone telefon teléfono téléphone mobile handy fax call card kreditkarte ip".split())
_CUE = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, NAME_CUES | ID_CUES | CONTACT_CUES), key=len, reverse=True)) + r")(?![^\W_])", re.I)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[\d@][^\x20\x09-\x0D]*")
_TRIM = "\"'.,:;!?()[]{}<>*#"
N_FEATURES = 20


def shape(form: str) -> list[int]:
    """Features of a token by itself."""
    digits = sum(c.isdigit() for c in form)
    letters = sum(c.isalpha() for c in form)
    out = [0]
    if form[:1].isupper() and form[1:].islower() and letters == len(form):
        out.append(1)
    if letters and form.isupper() and not digits:
        out.append(2)
    if digits:
        out.append(3 if digits < 4 else 4 if digits < 8 else 5)
    if digits and letters:
        out.append(6)
    if digits and digits + sum(c in "-./" for c in form) == len(form) and digits >= 6:
        out.append(7)
    if "@" in form:
        out.append(8)
    if letters and form.islower():
        out.append(9)
    return out


def features(tokens: list[str], i: int) -> list[int]:
    """Indices of the features that hold for token i: its shape and the cues up to three tokens before it."""
    out = shape(tokens[i].strip(_TRIM))
    if not i or tokens[i - 1][-1] in ".!?" and tokens[i - 1].strip(_TRIM).lower() not in NAME_CUES:
        out.append(19)  # starts a sentence
    for d in (1, 2, 3):
        if i - d < 0:
            break
        raw = tokens[i - d]
        cue = raw.strip(_TRIM).lower()
        kind = 0 if cue in NAME_CUES else 1 if cue in ID_CUES else 2 if cue in CONTACT_CUES else None
        if kind is not None:
            out.append(10 + kind * 3 + min(d, 3) - 1)
            break
        if raw[-1] in ".!?;" and len(raw) > 3:  # a sentence ended between
            break
    return out


def _made_sentences(n: int = 700, seed: int = 23) -> list[tuple[list[str], list[int], list[tuple[int, int]]]]:
    """Labelled token lists and their skip edges, by rule: syllable words, cues, fillers, names, numbers with and without a cue, repeats without a cue."""
    rng = np.random.default_rng(seed)
    syllables = "an ther ing on en tion ed ha re st ou nd le ment que ai ver ge ung heit ci os mar lo ka ri ben sol".split()
    word = lambda k=3: "".join(rng.choice(syllables, rng.integers(1, k + 1)))
    cues = {1: sorted(NAME_CUES), 2: sorted(ID_CUES), 3: sorted(CONTACT_CUES)}

    def number():
        form = rng.integers(4)
        d = "".join(map(str, rng.integers(0, 10, rng.integers(6, 13))))
        return d if form == 0 else f"{d[:3]}-{d[3:5]}-{d[5:]}" if form == 1 else rng.choice(["DE", "FR", "ES", "GB"]) + d if form == 2 else d[:4] + rng.choice(list("ABCXYZ")) + d[4:]

    def plain():
        """Numbers that are nobody's: counts, dates, words with a digit."""
        form = rng.integers(4)
        day = f"{rng.integers(1900, 2040)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
        return number() if form == 0 else f"{rng.integers(1, 999)},{rng.integers(100, 999)},{rng.integers(100, 999)}" if form == 1 else day if form == 2 else word(1).upper()[:2] + str(rng.integers(1, 3000)) if rng.random() < 0.5 else str(rng.integers(1, 100)) + word(1)

    fillers = "number no nr is was are nummer number: numéro número of the ist est es lautet".split()
    out = []
    for _ in range(n):
        tokens, labels = [], []

        def put(words, label, tokens=tokens, labels=labels):
            tokens.extend(words)
            labels.extend([label] * len(words))

        background = lambda: put([w if rng.random() > 0.15 else w.capitalize() if rng.random() > 0.2 else str(rng.integers(1, 3000)) if rng.random() < 0.5 else plain() for w in (word() for _ in range(rng.integers(3, 9)))], 0)  # noqa: B023, E731
        background()
        for _ in range(rng.integers(0, 3)):
            label = int(rng.integers(1, 4))
            cue = str(rng.choice(cues[label]))
            if rng.random() < 0.15:  # a cue with nothing after it
                put([cue if label > 1 else cue.capitalize()], 0)
                background()
                continue
            entity = [word(2).capitalize() + "x" for _ in range(rng.integers(1, 3))] if label == 1 else [number()] if label == 2 else [word(2) + f".{rng.integers(10, 99)}@mail.example.org" if rng.random() < 0.4 else number()]
            put([(cue.capitalize() if rng.random() < 0.6 else cue) + str(rng.choice(["", ":", "."]))], 0)
            if rng.random() < 0.4:
                put([str(f) for f in rng.choice(fillers, rng.integers(1, 3))], 0)
            put(entity, label)
            background()
            if rng.random() < 0.6:
                put(entity, label)  # again, without the cue
                background()
        at: dict[str, int] = {}
        skips = []
        for i, t in enumerate(tokens):
            f = form_key(t)
            if f:
                if f in at:
                    skips.append((at[f], i))
                at[f] = i
        out.append((tokens, labels, skips))
    return out


def form_key(token: str) -> str:
    """What similar tokens share: the digits of a number, else the letters in lower case; empty for plain small words."""
    form = token.strip(_TRIM)
    digits = "".join(c for c in form if c.isdigit())
    if len(digits) >= 4:
        return digits
    return form.lower() if len(form) > 2 and (form[0].isupper() or digits) else ""


_WEIGHTS: dict = {}


def weights() -> dict:
    """Unary (features x labels), chain (label x next label) and skip (symmetric) weights; the driver learns and sends them."""
    if not _WEIGHTS:
        made = _made_sentences()
        x, y, before, after, skip = [], [], [], [], []
        for tokens, labels, edges in made:
            beside = np.zeros((len(tokens), len(LABELS)))
            for i, j in edges:
                beside[i, labels[j]] += 1
                beside[j, labels[i]] += 1
            for i in range(len(tokens)):
                row = np.zeros(N_FEATURES)
                row[features(tokens, i)] = 1
                x.append(row)
                y.append(labels[i])
                before.append(np.eye(len(LABELS))[labels[i - 1] if i else 0])
                after.append(np.eye(len(LABELS))[labels[i + 1] if i + 1 < len(labels) else 0])
            skip.extend(beside)
        x, y, before, after, skip = np.stack(x), np.asarray(y), np.stack(before), np.stack(after), np.stack(skip)
        n, k = len(y), len(LABELS)
        u, t, s = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
        goal = np.eye(k)[y]
        speed = [np.zeros_like(u), np.zeros_like(t), np.zeros_like(s)]
        for _ in range(700):
            z = x @ u + before @ t + after @ t.T + skip @ s
            e = np.exp(z - z.max(1, keepdims=True))
            d = (goal - e / e.sum(1, keepdims=True)) / n
            g = skip.T @ d
            for v, grad, p in zip(speed, (x.T @ d, before.T @ d + (after.T @ d).T, (g + g.T) / 2), (u, t, s), strict=True):
                v *= 0.9
                v += 1.5 * (grad - 2e-5 * p)
                p += v
        _WEIGHTS.update(unary=u, chain=t, skip=s)
    return _WEIGHTS


def marginals(unary: np.ndarray, edges: list[tuple[int, int, int]], w: dict, rounds: int | None = None, damp: float = 0.3, forms: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities by loopy sum-product in the log domain. Edges: (i, j, 0 for chain i -> j, 1 for skip).

    `forms` numbers the tokens of a form alike, from 0 on, each at least twice; -1 is none. Without `rounds`, messages run
    until they settle, with a bound that grows with the longest chain.
    """
    k = unary.shape[1]
    i, j, kind = (np.asarray(c, np.int64) for c in zip(*edges, strict=True)) if edges else np.zeros((3, 0), np.int64)
    pot = np.where(kind[:, None, None] == 0, w["chain"], w["skip"])
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    pots = np.concatenate([pot, pot.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    msg = np.zeros((len(src), k))
    own = np.flatnonzero(forms >= 0) if forms is not None else np.zeros(0, np.int64)
    told = np.zeros((len(own), k))
    if rounds is None:
        linked = np.zeros(len(unary) + 1, bool)
        linked[j[(kind == 0) & (j == i + 1)]] = True
        gaps = np.flatnonzero(~linked)
        rounds = 100 + 2 * int(np.diff(gaps).max(initial=1))
    for step in range(rounds if len(src) or len(own) else 0):
        heard = unary.copy()
        np.add.at(heard, dst, msg)
        belief = heard.copy()
        belief[own] += told
        hold = damp if step < 60 else 0.7  # what still swings is held back more
        out = belief[src] - msg[back]
        z = out[:, :, None] + pots
        top = z.max(1)
        new = top + np.log(np.exp(z - top[:, None]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - msg).max(initial=0)
        msg = hold * msg + (1 - hold) * new
        if len(own):
            said = witnesses(heard[own], forms[own], w["skip"])
            change = max(change, np.abs(said - told).max())
            told = hold * told + (1 - hold) * said
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    belief[own] += told
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def witnesses(heard: np.ndarray, forms: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """What the node of its form tells each token: the skip message of the other token that speaks most for a label but O."""
    z = heard[:, :, None] + skip
    top = z.max(1)
    said = top + np.log(np.exp(z - top[:, None]).sum(1))
    said -= said.max(1, keepdims=True)
    order = np.lexsort((-(said[:, 1:].max(1) - said[:, 0]), forms))
    first = np.searchsorted(forms[order], forms)
    best = order[first]
    best = np.where(best == np.arange(len(forms)), order[first + 1], best)
    return said[best]


_HEAVY: dict = {}


def heavy(form: str, w: dict) -> bool:
    """Whether a token can be more than O by its shape, between tokens that are O."""
    key = tuple(shape(form))
    if key not in _HEAVY:
        own = w["unary"][list(key)].sum(0) + w["chain"][0] + w["chain"][:, 0]
        _HEAVY[key] = bool(own[1:].max() > own[0] - 2)
    return _HEAVY[key]


def field_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the field adds to the base spans of one document."""
    cues = [m.start() for m in _CUE.finditer(text)]
    marked = [m.start() for m in _MARKED.finditer(text)]
    if not cues and not base and not marked:
        return []
    w = weights()
    places = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    starts = np.asarray([a for a, _ in places])
    observed: dict[int, int] = {}
    for _, a, b in base:
        for i in range(int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b, side="left"))):
            observed[i] = 3
    live = set(observed)
    for i in (np.searchsorted(starts, cues, side="right") - 1).tolist():
        live.update(range(i + 1, min(i + 4, len(tokens))))
    live.update(i for i in set((np.searchsorted(starts, marked, side="right") - 1).tolist()) if heavy(tokens[i].strip(_TRIM), w))
    forms = {form_key(tokens[i]) for i in live} - {""}
    if forms:
        live.update(i for i, t in enumerate(tokens) if i not in live and form_key(t) in forms)
    if not live - set(observed):
        return []
    nodes = sorted(live)
    index = {t: k for k, t in enumerate(nodes)}
    unary = np.zeros((len(nodes), len(LABELS)))
    edges, alike = [], {}
    for k, t in enumerate(nodes):
        if t in observed:
            unary[k] = -50.0
            unary[k, observed[t]] = 0
        else:
            unary[k] = w["unary"][features(tokens, t)].sum(0)
        if t - 1 in index:
            edges.append((k - 1, k, 0))
        else:
            unary[k] += w["chain"][0]
        if t + 1 not in index:
            unary[k] += w["chain"][:, 0]
        f = form_key(tokens[t])
        if f:
            alike.setdefault(f, []).append(k)
    groups = np.full(len(nodes), -1)
    for n, own in enumerate(x for x in alike.values() if len(x) > 1):
        groups[own] = n
    label = marginals(unary, edges, w, forms=groups).argmax(1)
    out: list[tuple[str, int, int]] = []
    for k, t in enumerate(nodes):
        if not label[k] or t in observed:
            continue
        a, b = places[t]
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(_TRIM)), b - len(word) + len(word.rstrip(_TRIM))
        if a >= b:
            continue
        name = LABELS[label[k]].lower()
        if out and out[-1][0] == name and k and nodes[k - 1] == t - 1 and label[k - 1] == label[k] and places[t - 1][1] >= out[-1][2] and "\n" not in text[out[-1][2] : a]:
            out[-1] = (name, out[-1][1], b)
        else:
            out.append((name, a, b))
    taken = sorted((a, b) for _, a, b in base)
    return [s for s in out if not any(a < s[2] and s[1] < b for a, b in taken)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, ordered(base + field_spans(text, base))


def scan(column: pa.Array) -> list[pa.Array]:
    counts: list[list[int]] = [[] for _ in BASE]
    digests, spans = [], []
    for text in column.to_pylist():
        base, every = all_spans(text or "")
        for c, kind in zip(counts, BASE, strict=True):
            c.append(sum(s[0] == kind for s in base))
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append(joined(every))
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]


def masked(text: str) -> str:
    """The text with each span, or union of overlapping spans, replaced by its kind in brackets."""
    spans = sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2]))
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:] if out else text


def scan_personal(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns `carry` with counts, the digest of the base spans and all spans of each text."""
    learned = weights()

    def run(column: pa.Array) -> list[pa.Array]:
        _WEIGHTS.update(learned)
        return scan(column)

    return map_texts(docs, run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", carry)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` masked; n_chars, if there, is the new length; null texts stay null."""
    learned = weights()

    def mask(column: pa.Array) -> list[pa.Array]:
        _WEIGHTS.update(learned)
        return [pa.array([None if t is None else masked(t) for t in column.to_pylist()], pa.string())]

    raw = unused(docs.columns, "raw_text")[0]
    done = map_texts(docs.withColumnRenamed("text", raw), mask, "text string", [c for c in docs.columns if c != "text"], text=raw)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return scan_personal(table(spark, sf_dir, "documents"), ["doc_id"])
