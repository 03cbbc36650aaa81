"""Personal data by fixed patterns and a skip-chain conditional random field (operator 11).

Patterns find e-mail addresses, IP addresses, card and phone numbers.  What they miss, a phone number without its country
code or an address cut short, is often told by its surroundings: the same digits stand elsewhere in a full number.  A
random field labels the tokens of every document that has such spans.  Tokens inside pattern spans keep their label; other
tokens with a digit or ``@``, or that repeat a part of a span, are free.  A token's potential comes from its form,
neighbouring words and failed checks, neighbours in the text share a transition potential, and tokens that repeat or
resemble each other (equal text, equal last seven digits, equal local part) share a potential with a hidden label of their
group, however far apart; a group of n costs n messages, not n * n.  Loopy message passing runs over all documents of a
batch at once.  A kind may only be given in a document where a pattern found that kind, so documents without personal
data stay as they are.

Weights are fitted to the patterns' own spans by pseudo-likelihood on a bounded sample (``Sample``).  As the form nearly
gives the pattern away, it is hidden for half of the sampled tokens, so that neighbours and groups get weights too.

Defined results: a null text is an empty one, with no spans; positions are code points; each row is judged alone, so
repeats, ties and null keys matter to no other row.  Patterns take time in proportion to the text, whatever it holds."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and kinds of personal data, in the order of the result.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS_APART = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPECIAL = re.compile("[0-9@]")
WORD = re.compile(r"[^ \t-\r]+")
EDGE = ".,;:!?\"'<>[]{}|*#$&"   # characters that don't belong to a token at its ends
SIMILAR_DIGITS = 7
NEAR = 32                       # characters from which a token's neighbouring words are taken
STRENGTH = 6.0                  # prior of the potential that tokens of a group share
ROUNDS, CLOSE = 30, 1e-4        # of messages
SHAPES, NEIGHBOURS = 512, 256   # most frequent forms and neighbouring words of the sample that have weights


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents and tokens."""

    docs: int = 4_000
    tokens: int = 40_000
    steps: int = 200


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each @ in turn, so that long runs without one are never searched."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the patterns by kind and start, and matches that failed their check."""
    found = [("email", a, b) for a, b in _emails(text)]
    failed = []
    for kind, pattern in (("ip", IP), ("card", DIGITS_APART), ("phone", PHONE)):
        for m in pattern.finditer(text):
            s = m.group()
            if kind == "ip":
                good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
            else:
                digits = re.sub("[^0-9]", "", s)
                good = 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
            if good or kind != "card" or len(s) > 8:   # short numbers are no failed cards
                (found if good else failed).append((kind, *m.span()))
    return found, failed


def _shape(token: str) -> str:
    """Digits by their number, letters as one, other characters as they are."""
    def number(m: re.Match) -> str:
        n = len(m.group())
        return f"9{n if n < 5 else 8 if n < 9 else 12 if n < 13 else 19 if n < 20 else 99}."

    return re.sub(r"[0-9]+", number, re.sub(r"[^\W\d_]+", "a", token[:64]))[:32]


def _keys(token: str) -> set[str]:
    """What makes tokens similar."""
    low = token.lower()
    digits = re.sub("[^0-9]", "", token) if len(token) < 256 else ""
    out = set()
    if len(low) >= 4 and any(c.isdigit() or c in "@._-+" for c in low):
        out.add(low)
    if len(digits) >= 4:
        out.add("#" + digits[-SIMILAR_DIGITS:])
    local = low.partition("@")[0]
    if local != low and len(local) >= 4 and any(c.isdigit() or c in "._%+-" for c in local):
        out.add(local)
    return out


@dataclass
class Token:
    start: int
    end: int
    label: int          # of the pattern span it lies in, -1 if free
    form: str
    failed: int         # bits of the kinds whose check a match around it failed
    before: str         # neighbouring words
    after: str
    left: int           # index of the neighbouring token, -1 for an ordinary word
    right: int
    keys: set[str]


def tokens_of(text: str, found: list[tuple[str, int, int]], failed: list[tuple[str, int, int]]) -> list[Token]:
    """The tokens of a text that has pattern spans, as nodes of its random field."""
    inside = sorted((a, b, KINDS.index(k) + 1) for k, a, b in found)
    wrong = sorted((a, b, 1 << KINDS.index(k)) for k, a, b in failed)
    whole = set().union(*(_keys(text[a:b]) for a, b, _ in inside))
    words = []
    at = wrong_at = 0
    for m in WORD.finditer(text):
        s, e = m.span()
        while at < len(inside) and inside[at][1] <= s:
            at += 1
        while wrong_at < len(wrong) and wrong[wrong_at][1] <= s:
            wrong_at += 1
        # spans of different kinds may overlap: the first kind listed counts
        label, a, b = min(((k, a, b) for a, b, k in inside[at:at + len(KINDS)] if a < e and s < b), default=(0, 0, 0))
        raw = m.group()
        if label:
            s, e = max(s, a), min(e, b)
            token = text[s:e]
        else:
            token = raw.strip(EDGE)
            if not token:
                continue
            s += raw.index(token)
            e = s + len(token)
        bits = sum({k for a, b, k in wrong[wrong_at:wrong_at + len(KINDS)] if a < e and s < b})
        words.append((s, e, label, token, bits, text[a:b] if label and e == b else ""))
    nodes: list[Token] = []
    index: dict[int, int] = {}
    for i, (s, e, label, token, bits, span) in enumerate(words):
        low = token.lower()
        if not label and not (re.search("[0-9@]", token) or low in whole):
            continue
        index[i] = len(nodes)
        # the last token of a span stands for all of it
        keys = _keys(token) | ({low} & whole) | _keys(span)
        side = [words[j][3].strip(EDGE).lower()[:NEAR] if 0 <= j < len(words) else "" for j in (i - 1, i + 1)]
        nodes.append(Token(s, e, label or -1, _shape(token), bits, *side, index.get(i - 1, -1), -1, keys))
        if i - 1 in index:
            nodes[index[i - 1]].right = index[i]
    return nodes


@dataclass
class Field:
    """Weights of the random field."""

    shapes: dict[str, int]
    sides: dict[str, int]
    bias: np.ndarray        # label
    form: np.ndarray        # form, label; row 0 for all others
    before: np.ndarray
    after: np.ndarray
    failed: np.ndarray      # kind of the failed check, label
    follow: np.ndarray      # label of the token before, label
    strength: float         # of the potential shared by similar tokens

    def node(self, t: Token) -> np.ndarray:
        out = self.bias + self.form[self.shapes.get(t.form, 0)] + self.before[self.sides.get(t.before, 0)] + self.after[
            self.sides.get(t.after, 0)]
        for i in range(len(KINDS)):
            if t.failed >> i & 1:
                out = out + self.failed[i]
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def beliefs(node: np.ndarray, edges: np.ndarray, follow: np.ndarray, members: np.ndarray, hidden: np.ndarray,
            strength: float) -> np.ndarray:
    """Marginal label probabilities of the nodes by sum-product messages.

    ``node``, ``hidden``: log potentials of tokens and of the hidden labels of groups; ``edges``: pairs of neighbouring
    tokens; ``members``: pairs of a token and its group, which agree by ``strength``."""
    n, k = node.shape
    i, j = edges[:, 0], edges[:, 1]
    t, g = members[:, 0], members[:, 1]
    right, left = np.zeros((len(edges), k)), np.zeros((len(edges), k))      # messages to j, to i
    up, down = np.zeros((len(members), k)), np.zeros((len(members), k))     # to the group, to the token
    gain = np.expm1(strength)

    def agree(x: np.ndarray) -> np.ndarray:
        x = x - _log_sum(x)
        out = np.log1p(gain * np.exp(x))
        return out - _log_sum(out)

    def passed(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = _log_sum((x[:, :, None] + table[None]).transpose(0, 2, 1).reshape(-1, k)).reshape(-1, k)
        return out - _log_sum(out)

    for _ in range(ROUNDS):
        total = node.copy()
        np.add.at(total, j, right)
        np.add.at(total, i, left)
        np.add.at(total, t, down)
        group = hidden.copy()
        np.add.at(group, g, up)
        new = (passed(total[i] - left, follow), passed(total[j] - right, follow.T), agree(total[t] - down), agree(group[g] - up))
        change = max((float(np.abs(np.exp(a) - np.exp(b)).max()) for a, b in zip(new, (right, left, up, down)) if a.size), default=0.0)
        # half steps, so that loops settle
        right, left, up, down = (0.5 * (a + b) for a, b in zip(new, (right, left, up, down)))
        if change < CLOSE:
            break
    total = node.copy()
    np.add.at(total, j, right)
    np.add.at(total, i, left)
    np.add.at(total, t, down)
    return np.exp(total - _log_sum(total))


BARRED = -1e3


def label_documents(field: Field, documents: list[list[Token]]) -> list[dict[int, tuple[int, float]]]:
    """Of each document the free tokens that get a kind: index, label and probability."""
    free: list[tuple[int, int]] = []
    node, edges, members, hidden = [], [], [], []
    place: dict[tuple[int, int], int] = {}
    for d, tokens in enumerate(documents):
        allowed = {0, *(t.label for t in tokens if t.label > 0)}
        bar = np.array([0.0 if x in allowed else BARRED for x in range(len(LABELS))])
        for i, t in enumerate(tokens):
            if t.label < 0:
                place[d, i] = len(free)
                free.append((d, i))
                x = field.node(t) + bar
                for side, table in ((t.left, field.follow), (t.right, field.follow.T)):
                    known = 0 if side < 0 else tokens[side].label
                    if known >= 0:
                        x = x + table[known]
                    elif side == t.left:
                        edges.append((place[d, side], place[d, i]))
                node.append(x)
        groups = defaultdict(list)
        for i, t in enumerate(tokens):
            for key in t.keys:
                groups[key].append(i)
        for g in groups.values():
            some = [i for i in g if tokens[i].label < 0]
            if some and len(g) > 1:
                seen = np.zeros(len(LABELS))
                for label, n in Counter(tokens[i].label for i in g if tokens[i].label > 0).items():
                    seen[label] = n * field.strength
                members += [(place[d, i], len(hidden)) for i in some]
                hidden.append(seen)
    out: list[dict[int, tuple[int, float]]] = [{} for _ in documents]
    if free:
        pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
        found = beliefs(np.array(node), pairs(edges), field.follow, pairs(members), np.array(hidden).reshape(-1, len(LABELS)), field.strength)
        for (d, i), p in zip(free, found):
            best = int(p.argmax())
            if best:
                out[d][i] = (best, float(p[best]))
    return out


def added_spans(text: str, tokens: list[Token], labels: dict[int, tuple[int, float]], least: float) -> list[tuple[str, int, int]]:
    """Free tokens with a kind as spans; neighbours of one kind with a blank between are one."""
    out: list[list] = []
    for i in sorted(labels):
        label, p = labels[i]
        t = tokens[i]
        if p < least:
            continue
        if out and out[-1][0] == label and i - 1 == out[-1][3] and text[out[-1][2]:t.start].isspace() and t.start - out[-1][2] == 1:
            out[-1][2:] = [t.end, i]
        else:
            out.append([label, t.start, t.end, i])
    return [(KINDS[x - 1], a, b) for x, a, b, _ in out]


def find_spans(df: DataFrame, field: Field, text: Column, least: float = 0.5) -> Column:
    """All spans of a text as array<struct<kind, start, end, base>>, by kind as listed, then start; ``base`` tells
    those of the patterns, the others have a probability of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(field)   # a few thousand weights, whatever the data

    @F.arrow_udf("array<struct<kind: string, start: int, end: int, base: boolean>>")
    def find(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        spans: list[list] = [[] for _ in texts]
        open_ = []
        for i, t in enumerate(texts):
            if not t or not SPECIAL.search(t):
                continue
            found, failed = base_spans(t)
            if found:
                spans[i] = [(k, a, b, True) for k, a, b in found]
                tokens = tokens_of(t, found, failed)
                if any(x.label < 0 for x in tokens):
                    open_.append((i, tokens))
        labels = label_documents(shared.value, [tokens for _, tokens in open_])
        for (i, tokens), some in zip(open_, labels):
            spans[i] += [(k, a, b, False) for k, a, b in added_spans(texts[i], tokens, some, least)]
            spans[i].sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        ends = np.cumsum([0, *map(len, spans)]).astype(np.int32)
        flat = [s for some in spans for s in some]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
        rows = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], k) for i, k in enumerate(kinds)], ["kind", "start", "end", "base"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return find(text)



TRAINING = ("label int, form string, failed int, before string, after string, lead int, next int, allowed int, alike int, hide boolean, h bigint")


def _training_rows(text: str) -> list[tuple]:
    """Tokens of a text with what the field looks at; ``alike``: bits of the labels of other tokens with equal text."""
    found, failed = base_spans(text)
    if not found:
        return []
    tokens = tokens_of(text, found, failed)
    allowed = 1 | sum({1 << t.label for t in tokens if t.label > 0})
    same = defaultdict(Counter)
    for t in tokens:
        same[text[t.start:t.end].lower()][max(t.label, 0)] += 1
    label = lambda i: 0 if i < 0 else max(tokens[i].label, 0)
    out = []
    for t in tokens:
        mine = max(t.label, 0)
        others = same[text[t.start:t.end].lower()] - Counter({mine: 1})
        # a free token that repeats a span's may be what the patterns miss: no example, and no evidence for others
        if not mine and any(others):
            continue
        if mine:
            others.pop(0, None)
        h = xxhash.xxh64_intdigest(f"{t.start} {text[max(0, t.start - 99):t.end + 99]}") >> 1
        out.append((mine, t.form, t.failed, t.before, t.after, label(t.left), label(t.right), allowed,
                    sum(1 << x for x in others), bool(h >> 5 & 1), h))
    return out


def fit(df: DataFrame, *, text: str = "text", sample: Sample = Sample()) -> Field:
    """Weights from the patterns' spans in a sample of the texts, by hash; copies count once."""
    rows = df.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("t"))
    step = max(1, rows.count() // sample.docs)
    some = rows.where(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(step)) == 0).distinct()
    some = some.orderBy(F.xxhash64("t", F.lit(7)), "t").limit(2 * sample.docs)

    def seen(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() for r in _training_rows(t)]
            names = [x.split()[0] for x in TRAINING.split(", ")]
            kinds = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[x.split()[1]]
                     for x in TRAINING.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    table = some.mapInArrow(seen, TRAINING).orderBy("h", "label", "form", "before", "after").limit(sample.tokens).toArrow()
    return learn({n: table[n].to_pylist() for n in table.column_names}, sample.steps)


def learn(rows: dict[str, list], steps: int) -> Field:
    """Pseudo-likelihood: each token's label given its features and the labels around it, by gradient steps."""
    n, k = len(rows["label"]), len(LABELS)
    shapes = {s: i + 1 for i, (s, _) in enumerate(sorted(Counter(rows["form"]).items(), key=lambda x: (-x[1], x[0]))[:SHAPES])}
    words = Counter(rows["before"]) + Counter(rows["after"])
    sides = {s: i + 1 for i, (s, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:NEIGHBOURS])}
    w = {"bias": np.zeros(k), "form": np.zeros((len(shapes) + 1, k)), "before": np.zeros((len(sides) + 1, k)),
         "after": np.zeros((len(sides) + 1, k)), "failed": np.zeros((len(KINDS), k)), "follow": np.zeros((k, k))}
    strength = STRENGTH
    if n:
        label, lead, then = (np.array(rows[c]) for c in ("label", "lead", "next"))
        shown = (~np.array(rows["hide"])).astype(float)[:, None]
        form = np.array([shapes.get(s, 0) for s in rows["form"]])
        left, right = (np.array([sides.get(s, 0) for s in rows[c]]) for c in ("before", "after"))
        bits = (np.array(rows["failed"])[:, None] >> np.arange(len(KINDS)) & 1) * shown
        bar = np.where(np.array(rows["allowed"])[:, None] >> np.arange(k) & 1, 0.0, BARRED)
        alike = (np.array(rows["alike"])[:, None] >> np.arange(k) & 1).astype(float)
        want = np.eye(k)[label]
        rate, speed, size = 0.5, {}, {}
        for step in range(1, steps + 1):
            z = (w["bias"] + w["form"][form] * shown + w["before"][left] + w["after"][right] + bits @ w["failed"]
                 + w["follow"][lead] + w["follow"].T[then] + strength * alike + bar)
            wrong = want - np.exp(z - _log_sum(z))
            grow = {x: np.zeros_like(w[x]) for x in w}
            grow["bias"] = wrong.sum(axis=0)
            np.add.at(grow["form"], form, wrong * shown)
            np.add.at(grow["before"], left, wrong)
            np.add.at(grow["after"], right, wrong)
            grow["failed"] = bits.T @ wrong
            np.add.at(grow["follow"], lead, wrong)
            np.add.at(grow["follow"].T, then, wrong)
            for x in w:   # adaptive steps with a small pull to zero
                g = (grow[x] - 3.0 * w[x]) / n
                speed[x] = 0.9 * speed.get(x, 0) + 0.1 * g
                size[x] = 0.99 * size.get(x, 0) + 0.01 * g * g
                w[x] += 0.2 * rate * speed[x] / (1 - 0.9 ** step) / (np.sqrt(size[x] / (1 - 0.99 ** step)) + 1e-6)
            strength += rate * (float((wrong * alike).sum()) - 0.5 * (strength - STRENGTH)) / n
            strength = min(max(strength, 1.0), 9.0)
    return Field(shapes, sides, **w, strength=strength)
