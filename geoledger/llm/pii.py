"""Personal data: patterns for what has a fixed form, a skip-chain conditional random field for the rest.

Tokens with a digit or an @ (or an [at] in brackets) are nodes. A node has a unary potential from its shape and neighbours, a chain
potential with the node beside it, and skip potentials with distant tokens of the same digits or the same text; loopy message passing
over each document then makes repeats agree. Nodes that a base pattern covers are fixed at its label, so that what the patterns
find once is found again where it is written in another form. A repeated token is tied to its previous and to its first
place only, so that a document's graph grows with its length. Similar is: the same last seven digits, or the same mailbox.
A number may be written in groups: a run of nodes side by side (or in one base span) ends in a number of up to RUN_DIGITS digits,
and the nodes of two runs are tied as far as their digits agree from the end on; a run is also tied to the last one in a base span.

The field is taught in lessons from a bounded sample of documents (SAMPLE_DOCS by a hash of the text, whole, as long as they hold
SAMPLE_NODES nodes together): each document as it is, and once more with its base spans hidden, that is rewritten so that no pattern matches
(phones without their plus, addresses with [at] and [dot]) but with their labels, and with mentions repeated further on. Keys given to a name
(token = "...") teach a fifth kind, secret. Plain numbers that aren't personal (years, dates, amounts, versions) are taught as such.
So unary, chain and skip potentials for what patterns miss are learned by pseudo-likelihood, not set.
Base spans are always kept; the field adds spans that touch none of them.

Defined results: null text is an empty text (no spans); repeated rows and null ids stay; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, texts

KINDS = ("email", "ip", "card", "phone")
#: What the field labels: the base kinds, and keys given to a name.
LABELS = (*KINDS, "secret")
#: Documents and nodes of all of them that the field is fitted on, at most; hashed features; probability from which a node is labelled.
SAMPLE_DOCS, SAMPLE_NODES, HASHED, SURE = 4000, 200_000, 1 << 13, 0.7
#: Digits of the longest number that is looked for in groups (a card's), and those that two runs must share at their ends.
RUN_DIGITS, SHARED_DIGITS = 19, 7
#: Log-odds that tied nodes share a kind, before any are seen in the sample.
AGREE = 2.0
#: Edges that pass their messages at once.
EDGES = 1 << 16
#: Documents of plain numbers among the lessons.
PLAIN = 300

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The base patterns; the local part of an email is found by walking back from its @.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the pattern's matches begin where a run of digits does, so runs are read once
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[^\w@]*[0-9]+([().,/-]+[0-9]+)*[^\w@]*")
_AT = r"[\[({](?:at|AT)[\])}]"
_DIGIT, _NODE, _NOT_DIGIT, _SPACE = re.compile(r"[0-9]"), re.compile(rf"[0-9@]|{_AT}"), re.compile(r"[^0-9]+"), re.compile(r"\s")
_HIDDEN = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:(?:\.|[\[({{](?:dot|DOT)[\])}}])[\w-]+)+")
_GIVEN = re.compile(r"(?i)\b(?:token|secret|key|password|passwd|pwd|apikey|api_key)[\"']?\s?[=:]\s?[\"']?([A-Za-z0-9+/_=-]{16,})")
_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.start(), m.end(), "ip"


def base_spans(text: str) -> list[Span]:
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += _ips(text) if "." in text else ()
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], LABELS.index(s[2]), s[1]))


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


@dataclasses.dataclass
class Graph:
    """A document's nodes: places, hashed features, labels fixed by base spans (-1: none), chain and skip edges."""

    places: list[tuple[int, int]]
    hashed: list[list[int]]
    fixed: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(text: str, base: list[Span], taught: list[Span] = ()) -> Graph:
    """taught: spans whose labels are known though no base pattern tells them (in lessons)."""
    places, at = [], 0
    while m := _NODE.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        gap = _SPACE.search(text, m.end())
        end = gap.start() if gap else len(text)
        places.append((start, end))
        at = end
    fixed, hashed, chain, skip, seen, k = [], [], [], [], {}, 0
    said, joined, runs = [], [], {}  # a node's digits; whether the number may go on from the node before; last seven digits to runs
    for i, (a, b) in enumerate(places):
        while k < len(base) and base[k][1] <= a:
            k += 1
        cover = next((s for s in base[k : k + 4] if s[0] < b and a < s[1]), None)
        known = cover or next((s for s in taught if s[0] < b and a < s[1]), None)
        fixed.append(LABELS.index(known[2]) + 1 if known else -1)
        if i and a - places[i - 1][1] <= 1:
            chain.append((i - 1, i))
        token = text[a:b]
        hashed.append(_hashed(token, text[max(0, a - 32) : a].split()[-2:], text[b : b + 24].split()[:1]))
        digits = _NOT_DIGIT.sub("", token)
        core = token.strip(".,;:!?()[]<>\"'").lower()
        mailbox = core.replace("[at]", "@").replace("(at)", "@").replace("{at}", "@").partition("@")
        mailbox = mailbox[0] if mailbox[1] else ""
        said.append(digits)
        beside = i > 0 and (bool(chain and chain[-1] == (i - 1, i)) or (cover is not None and cover[0] < places[i - 1][1]))
        joined.append(beside and _GROUP.fullmatch(token) is not None and _GROUP.fullmatch(text[slice(*places[i - 1])]) is not None and "+" not in token)
        run = _run(said, joined, i)
        if run and len(run[0]) >= SHARED_DIGITS:
            first, before, based = runs.get(run[0][-SHARED_DIGITS:], (run, None, None))
            latest = before or first
            if latest is not run and latest[1][0][0] >= run[1][-1][0]:  # digits that repeat on and on: the same mention yet, not another
                runs[run[0][-SHARED_DIGITS:]] = (first, before, run if cover is not None else based)
            else:
                skip += sorted({e for other in (first, before, based) if other and other is not run for e in _ties(other, run, other is based or cover is not None)})
                runs[run[0][-SHARED_DIGITS:]] = (first, run, run if cover is not None else based)
        for key in {core if len(core) >= 6 else "", f"@{mailbox}" if mailbox else ""} - {""}:
            if key in seen:
                skip += [(j, i) for j in {seen[key][0], seen[key][1]}]
                seen[key] = (seen[key][0], i)
            else:
                seen[key] = (i, i)
    return Graph(places, hashed, fixed, chain, skip)


Run = tuple[str, list[tuple[int, int, int]]]


def _run(said: list[str], joined: list[bool], last: int) -> Run:
    """The digits of the longest number that ends with a node, and its nodes from there back: (node, digits after it, digits up to its start)."""
    digits, nodes, i = said[last], [(last, 0, len(said[last]))], last
    while joined[i] and len(digits) + len(said[i - 1]) <= RUN_DIGITS:
        i -= 1
        nodes.append((i, len(digits), len(digits) + len(said[i])))
        digits = said[i] + digits
    return digits, nodes


def _ties(a: Run, b: Run, all_of_them: bool) -> list[tuple[int, int]]:
    """Edges between the nodes of two runs that lie in the digits which both end with (of a compact number, the seven last are enough); only
    between nodes that share a digit's place, unless all of them are to be tied."""
    shared = next((n for n, (x, y) in enumerate(zip(reversed(a[0]), reversed(b[0]), strict=False)) if x != y), min(len(a[0]), len(b[0])))
    (left, right) = ([(i, x, y) for i, x, y in nodes if y <= shared or x + SHARED_DIGITS <= shared] for _, nodes in (a, b))
    return [(min(i, j), max(i, j)) for i, x, y in left for j, u, v in right if i != j and (all_of_them or (x < v and u < y))]


def _hashed(token: str, before: list[str], after: list[str]) -> list[int]:
    """Twelve features as numbers below HASHED."""
    core = token.strip(".,;:!?[]<>\"'*#%&$|")
    digits = sum(c.isdigit() for c in core)
    shape = re.sub(r"a+", "a", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in core[:40]))[:20]
    mixed = sum(x.isdigit() != y.isdigit() for x, y in zip(core[:64], core[1:64], strict=False))  # keys go to and fro between letters and digits
    last, previous = (before[-1].lower()[-12:] if before else ""), (before[-2].lower()[-12:] if len(before) > 1 else "")
    given = last.strip("\"'")[-1:] in ("=", ":")
    at = "@" in core or _HIDDEN.fullmatch(core) is not None
    said = ("bias", f"d{min(digits, 20)}", f"l{min(len(core), 24)}", f"s{shape}", f"@{at}", f".{min(core.count('.'), 6)}", f"-{min(core.count('-'), 4)}", f"c{12 <= digits <= 19 and luhn(_NOT_DIGIT.sub('', core))}", f"p{last}", f"n{after[0].lower()[:12] if after else ''}", f"m{min(mixed, 8)}{_SECRET.fullmatch(core) is not None}{at}", f"g{previous if given else ''}")
    return [zlib.crc32(x.encode()) % HASHED for x in said]


def _rewritten(said: str, kind: str, rng: random.Random, again: bool = False) -> str:
    """A mention in a form that no base pattern matches; again: in one that only its first mention explains."""
    digits = _NOT_DIGIT.sub("", said)
    if kind == "email":
        name, _, host = said.partition("@")
        return f"{name}{rng.choice(['[at]', '(at)'])}{host if rng.random() < 0.5 else host.replace('.', '[dot]')}"
    if kind == "phone":
        own = digits[max(0, len(digits) - 10) :]
        if again and rng.random() < 0.6:
            cuts = rng.choice([[], [2, 4, 6, 8], [3, 6], [3], [6]])
            return " ".join(own[a:b] for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True))
        return rng.choice([f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]} {own[3:6]} {own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}"])
    return said  # cards are found however they are grouped; addresses have one form


def given_secrets(text: str) -> list[Span]:
    """Keys given to a name; they need both letters and digits."""
    return [(*m.span(1), "secret") for m in _GIVEN.finditer(text) if _DIGIT.search(m[1]) and not m[1].isdigit()]


def lessons(text: str) -> list[Graph]:
    """The document as it is, and with its spans hidden and mentioned again."""
    rng, base = random.Random(zlib.crc32(text.encode())), base_spans(text)
    known = ordered(base + [s for s in given_secrets(text) if not any(s[0] < x[1] and x[0] < s[1] for x in base)])
    graphs = [graph(text, base, [s for s in known if s[2] == "secret"])]
    if not known:
        return graphs
    parts, taught, at, done = [], [], 0, 0

    def put(piece: str, kind: str | None = None) -> None:
        nonlocal at
        if kind:
            taught.append((at, at + len(piece), kind))
        parts.append(piece)
        at += len(piece)

    for a, b, kind in known:
        if a < done:
            continue
        put(text[done:a])
        put(_rewritten(text[a:b], kind, rng) if rng.random() < 0.5 else text[a:b], kind)
        done = b
    put(text[done:])
    for a, b, kind in known[:50]:
        if rng.random() < 0.5:
            put(f" {rng.choice(['and', 'later', 'see', 'the', '|', ''])} ")
            put(_rewritten(text[a:b], kind, rng, True), kind)
            put(rng.choice([" ", ", then ", ". ", "; "]) + "again")
    new = "".join(parts)
    found = base_spans(new)
    return [*graphs, graph(new, found, taught)]


def plain_numbers(n: int = PLAIN) -> list[Graph]:
    """Lessons of numbers that are nobody's: years, dates, times, amounts, versions, counts, checksums."""
    rng, graphs = random.Random(17), []
    words = ["the", "of", "in", "and", "from", "about", "with", "see", "page", "section", "number", "order", "code"]
    for _ in range(n):
        r = rng.randint
        kinds = [f"{r(1800, 2100)}", f"{r(1900, 2100)}-{r(1, 12):02}-{r(1, 28):02}", f"{r(1900, 2000)}-{r(2001, 2050)}", f"{r(0, 23)}:{r(0, 59):02}", f"{r(1, 999)},{r(0, 999):03}", f"{r(1, 99)}.{r(0, 99)}", f"v{r(0, 9)}.{r(0, 20)}.{r(0, 9)}", f"({r(1800, 2100)})", f"({r(1, 99)})", f"{r(1, 99)}%", f"{r(1, 10**r(1, 12))}", f"{r(1, 28)}.{r(1, 12)}.{r(1900, 2100)}", f"{r(100, 999)} {r(100, 999)}", f"{r(1, 99)}-{r(1, 99)}", f"978-{r(0, 9)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 9)}", f"{r(1, 9)}e{r(1, 9)}", f"x{r(1, 99)}", f"#{r(1, 9999)}", f"{rng.getrandbits(160):040x}", f"{rng.getrandbits(28):07x}"]
        text = " ".join(x for k in rng.sample(kinds, 8) for x in (rng.choice(words), k))
        graphs.append(graph(text, []))
    return graphs


@dataclasses.dataclass
class Field:
    """unary[feature, label]; chain[left, right]; skip[label, label]. Label 0 is nothing."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


N = len(LABELS) + 1


def fit(graphs: list[Graph], rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> Field:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels, by gradient steps (Adagrad)."""
    hashed, labels, pairs, offset = [], [], {"chain": [], "skip": []}, 0
    for g in graphs:
        hashed += g.hashed
        labels += [max(0, x) for x in g.fixed]
        for name in pairs:
            pairs[name] += [(a + offset, b + offset) for a, b in getattr(g, name)]
        offset += len(g.places)
    unary, chain, prior = np.zeros((HASHED, N)), np.zeros((N, N)), np.diag([0.0] + [AGREE] * len(LABELS))
    skip = prior.copy()
    if not labels:
        return Field(unary, chain, skip)
    x, y = np.array(hashed), np.array(labels)
    one = np.eye(N)[y]
    c, s = (np.array(pairs[k], int).reshape(-1, 2) for k in ("chain", "skip"))
    right, left, near = np.zeros((len(y), N)), np.zeros((len(y), N)), np.zeros((len(y), N))
    np.add.at(left, c[:, 1], one[c[:, 0]])
    np.add.at(right, c[:, 0], one[c[:, 1]])
    np.add.at(near, s[:, 0], one[s[:, 1]])
    np.add.at(near, s[:, 1], one[s[:, 0]])
    # whether a node that is tied to a labelled one, but has no label, is personal data is what the field is to tell
    known = ((y > 0) | (near[:, 1:].sum(1) == 0))[:, None]
    sums = [np.full(p.shape, 1e-3) for p in (unary, chain, skip)]
    for _ in range(rounds):
        z = unary[x].sum(1) + left @ chain + right @ chain.T + near @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        r = known * (one - p / p.sum(1, keepdims=True)) / len(y)
        du = np.stack([np.bincount(x.ravel(), np.repeat(r[:, k], x.shape[1]), HASHED) for k in range(N)], 1)
        ds = near.T @ r
        for param, step, total in zip((unary, chain, skip), (du, left.T @ r + (right.T @ r).T, (ds + ds.T) / 2), sums, strict=True):
            step -= l2 * (param - prior if param is skip else param) / len(y) ** 0.5
            total += step**2
            param += rate * step / np.sqrt(total)
    return Field(unary, chain, skip)


def marginals(graphs: list[Graph], field: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product over the documents' graphs at once: a row of label probabilities for each node."""
    hashed = [h for g in graphs for h in g.hashed]
    if not hashed:
        return np.empty((0, N))
    offsets = np.cumsum([0, *(len(g.places) for g in graphs)])
    unary = field.unary[np.array(hashed)].sum(1)
    fixed = np.array([f for g in graphs for f in g.fixed])
    known = fixed >= 0
    unary[known] = -30.0
    unary[known, fixed[known]] = 30.0
    ends, kinds = [], []
    for name, table in (("chain", field.chain), ("skip", field.skip)):
        start = len(ends)
        for g, o in zip(graphs, offsets, strict=False):
            ends += [(a + o, b + o) for a, b in getattr(g, name)]
        # some edges at a time: what they need besides their messages is much more than those
        kinds += [(slice(i, min(i + EDGES, len(ends))), np.exp(table)) for i in range(start, len(ends), EDGES)]
    log_sum = lambda v: (m := v.max(1, keepdims=True)) + np.log(np.exp(v - m).sum(1, keepdims=True))
    norm = lambda v: v - log_sum(v)
    if not ends:
        return np.exp(norm(unary))
    e = np.array(ends)
    forth, back = np.zeros((len(e), N)), np.zeros((len(e), N))  # to the right end, to the left end

    def beliefs() -> np.ndarray:
        return unary + np.stack([np.bincount(e[:, 1], forth[:, k], len(unary)) + np.bincount(e[:, 0], back[:, k], len(unary)) for k in range(N)], 1)

    def passed(v: np.ndarray, table: np.ndarray) -> np.ndarray:
        return norm(np.log(np.exp(v - v.max(1, keepdims=True)) @ table))

    for _ in range(rounds):
        b, change = beliefs(), 0.0
        for part, table in kinds:
            new_forth, new_back = passed(b[e[part, 0]] - back[part], table), passed(b[e[part, 1]] - forth[part], table.T)
            change = max(change, np.abs(new_forth - forth[part]).max(), np.abs(new_back - back[part]).max())
            forth[part], back[part] = damping * forth[part] + (1 - damping) * new_forth, damping * back[part] + (1 - damping) * new_back
        if change < 1e-4:
            break
    return np.exp(norm(beliefs()))


def added_spans(text: str, g: Graph, p: np.ndarray) -> list[Span]:
    """Spans of nodes that no base span covers and that are surely labelled; phone nodes side by side make one."""
    found: list[Span] = []
    for i, (a, b) in enumerate(g.places):
        label = int(p[i].argmax()) if g.fixed[i] < 0 else 0
        if not label or p[i, label] < SURE:
            continue
        kind = LABELS[label - 1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not (text[b - 1].isalnum() or (kind == "secret" and text[b - 1] in "=/+_-")):
            b -= 1
        if kind == "secret":  # the key itself, without the name that it is given to
            m = max(_SECRET.finditer(text, a, b), key=lambda m: len(m[0]), default=None)
            a, b = m.span() if m else (b, b)
        if found and kind in ("phone", "card") and found[-1][2] == kind and a - found[-1][1] <= 2 and (i - 1, i) in g.chain:
            found[-1] = (found[-1][0], b, kind)
        elif a < b:
            found.append((a, b, kind))
    return [s for s in found if _possible(text[s[0] : s[1]], s[2])]


def _possible(said: str, kind: str) -> bool:
    """Whether a span can be of its kind at all, however it is written."""
    digits = _NOT_DIGIT.sub("", said)
    return {"email": "@" in said or _HIDDEN.fullmatch(said) is not None, "secret": _SECRET.fullmatch(said) is not None and bool(digits) and len(digits) < len(said), "ip": 4 <= len(digits) <= 12, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 7 <= len(digits) <= 15}[kind]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fits the field on the driver, from a sample of bounded size."""
    n, parts = docs.count(), 1 << 20
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) < int(parts * min(1.0, 0.9 * sample_docs / max(n, 1)) + 1)).select(empty_text()).filter(F.col("text").rlike("[0-9@]")).limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = SAMPLE_NODES  # a limited table is one task
        for batch in batches:
            rows = []
            for text in texts(batch):
                for g in lessons(text):
                    if len(g.places) <= left:
                        left -= len(g.places)
                        rows.append({"hashed": g.hashed, "fixed": g.fixed, "chain": [list(e) for e in g.chain], "skip": [list(e) for e in g.skip]})
            nested = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("hashed", nested), ("fixed", pa.list_(pa.int64())), ("chain", nested), ("skip", nested)]))

    nested = "array<array<long>>"
    rows = sample.coalesce(1).mapInArrow(run, f"hashed {nested}, fixed array<long>, chain {nested}, skip {nested}").collect()
    graphs = [Graph([(0, 0)] * len(r.fixed), r.hashed, r.fixed, [tuple(e) for e in r.chain], [tuple(e) for e in r.skip]) for r in rows if r.fixed]
    return fit(sorted(graphs, key=lambda g: (g.fixed, g.hashed)) + (plain_numbers() if graphs else []))


def _spans(batch_texts: list[str], field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base, all) for each text."""
    base = [base_spans(t) for t in batch_texts]
    graphs = [graph(t, b) for t, b in zip(batch_texts, base, strict=True)]
    p, at = marginals(graphs, field), 0
    for text, b, g in zip(batch_texts, base, graphs, strict=True):
        more = added_spans(text, g, p[at : at + len(g.places)])
        at += len(g.places)
        yield b, ordered(b + [s for s in more if not any(s[0] < x[1] and x[0] < s[1] for x in b)]) if more else b


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (of the base kinds, added ones too), n_spans and secrets (spans of keys) for each document."""
    field = field or learn(docs)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long, secrets string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_spans(texts(batch), field))
            columns = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            sums = pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found], pa.string())
            spans, secrets = ([[x for x in s if (x[2] in KINDS) == base] for _, s in found] for base in (True, False))
            told = (pa.array([said(s) for s in spans], pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array([said(s) for s in secrets], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns, sums, *told], [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", empty_text()).mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in brackets; overlapping spans are one, of the kind that begins first."""
    parts, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with their spans masked, n_chars brought up to date; other columns and clean texts stay."""
    field = field or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column("text").to_pylist()
            new = [masked(t or "", s) if s else t for t, (_, s) in zip(kept, _spans([t or "" for t in kept], field), strict=True)]
            columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                was = batch.column("n_chars").to_pylist()
                columns["n_chars"] = pa.array([w if a == b else len(b) for w, a, b in zip(was, kept, new, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
