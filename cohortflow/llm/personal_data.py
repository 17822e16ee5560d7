"""Personal data in texts: fixed patterns, and spans that a semi-Markov conditional random field finds beside them."""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.common import text_of

# Kinds in the order in which they are listed, and their base patterns.
KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
DOMAIN = r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
LOCAL = "A-Za-z0-9._%+-"
#: A match of the address pattern starts where a run of digits starts, so no run is tried from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN, _NOT_LOCAL = re.compile(DOMAIN), re.compile(f"[^{LOCAL}]")

Span = tuple[int, int, int]  # start, kind, end; code points


# ---- base spans ----

def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    """Whether the check digit of a number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d if d < 5 else d - 9) + d if i % 2 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, from the at signs outwards: the time is linear in any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap, of every kind for itself; a match that fails its check is dropped whole. Sorted."""
    out = [(a, EMAIL, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        found = digits_of(m.group()) if m.end() - m.start() < 40 else ""
        if 12 <= len(found) <= 19 and luhn(found):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# ---- segments ----

#: An entity is at most this many tokens: digit runs, letter runs and single other characters.
MAX_TOKENS = 40
_ISLAND = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
FEATURES = [
    "bias", "digits_below_9", "digits_9", "digits_10", "digits_11", "digits_12_15", "digits_16_up", "check_digit", "starts_plus", "starts_parenthesis", "starts_digit",
    "parentheses", "hyphens", "blanks", "dots", "one_group", "equal_groups", "groups", "octets", "joined_left", "joined_right", "glued_left", "glued_right", "dotted_left", "dotted_right", "dotted_domain", "letters", "tokens",
]
_F = {name: i for i, name in enumerate(FEATURES)}


def islands(text: str) -> list[tuple[int, str]]:
    """Runs of neighbouring words that hold digits or an at sign, where enough of them stand for an entity: no segment lies elsewhere."""
    out = []
    for m in _ISLAND.finditer(text):
        run = m.group()
        if "@" in run or sum(map(run.count, "0123456789")) >= 7 or run.count(".") >= 3:
            out.append((m.start(), run))
    return out


@dataclass
class Lattice:
    """Candidate segments of one island: first and last token (exclusive), kind, features; `places` are the tokens' starts and the end."""

    places: list[int]
    start: np.ndarray
    stop: np.ndarray
    kind: np.ndarray
    features: np.ndarray


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class _Tokens:
    """Running sums over the tokens of one island, from which the features of any segment follow."""

    def __init__(self, island: str):
        found = [m.group() for m in _TOKEN.finditer(island)]
        self.n = len(found)
        sizes = np.array([len(t) for t in found])
        self.places = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        first = np.array([t[0] for t in found])
        self.digit = np.array(["0" <= t[0] <= "9" for t in found])
        self.letter = np.array([t[0].isalpha() for t in found])
        self.first = first
        self.n_digits = _sums(np.where(self.digit, sizes, 0))
        self.count = {c: _sums(first == c) for c in "+@().-_% "}
        self.letters, self.groups = _sums(self.letter), _sums(self.digit)
        octet = np.array([d and len(t.lstrip("0")) <= 3 and int(t.lstrip("0") or 0) <= 255 and len(t) <= 3 for t, d in zip(found, self.digit)])
        self.octets = _sums(octet)
        self.others = _sums(~(self.digit | self.letter | np.isin(first, list("+@().-_% "))))
        self.group_size = np.where(self.digit, sizes, 0)
        self.squares = _sums(self.group_size.astype(np.float64) ** 2)
        # check sums from either parity of the last digit's place
        d = np.frombuffer("".join([t for t, is_digit in zip(found, self.digit) if is_digit]).encode(), np.uint8).astype(np.int64) - 48
        twice = np.where(d < 5, 2 * d, 2 * d - 9)
        even = np.arange(len(d)) % 2 == 0
        self.odd_twice, self.even_twice = _sums(np.where(even, d, twice)), _sums(np.where(even, twice, d))
        # an opening parenthesis closed in its turn: depth never falls below zero inside
        self.depth = _sums((first == "(").astype(np.int64) - (first == ")"))
        self.before = np.concatenate([[" "], [t[-1] for t in found]])
        self.after = np.concatenate([first, [" "]])  # the token that starts at a place
        self.word_before, self.word_after = np.char.isalnum(self.before), np.char.isalnum(self.after)

    def block(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All candidates whose first token lies in [low, high)."""
        i = np.repeat(np.arange(low, high), MAX_TOKENS)
        j = i + np.tile(np.arange(1, MAX_TOKENS + 1), high - low)
        inside = j <= self.n
        i, j = i[inside], j[inside]
        inner = {c: s[j] - s[i] for c, s in self.count.items()}
        n_digits, letters, others = self.n_digits[j] - self.n_digits[i], self.letters[j] - self.letters[i], self.others[j] - self.others[i]
        groups, ends_digit, starts_digit = self.groups[j] - self.groups[i], self.digit[j - 1], self.digit[i]
        number = (letters == 0) & (others == 0) & (inner["@"] == 0) & (inner["_"] == 0) & (inner["%"] == 0) & ends_digit & ~self.word_before[i] & ~self.word_after[j]
        plain = number & (inner["+"] == 0) & starts_digit & (inner["("] == 0) & (inner[")"] == 0)
        ok = {
            IP: plain & (j - i == 7) & (inner["."] == 3) & (groups == 4) & (self.octets[j] - self.octets[i] == 4),
            CARD: plain & (n_digits >= 12) & (n_digits <= 19) & (j - i == 2 * groups - 1),
            PHONE: number & (n_digits >= 7) & (n_digits <= 15) & (inner["("] == inner[")"]) & (inner["("] <= 1) & (inner["+"] == (self.first[i] == "+")) & (starts_digit | (self.first[i] == "+") | (self.first[i] == "(")),
            EMAIL: (inner["@"] == 1) & (others == 0) & (inner[" "] == 0) & (inner["("] == 0) & (inner[")"] == 0) & (self.letters[j] > self.letters[i]) & (ends_digit | self.letter[j - 1]) & (self.first[i] != "@") & (self.first[i] != "."),
        }
        at = np.concatenate([np.nonzero(ok[k])[0] for k in range(4)])
        kind = np.repeat(np.arange(4), [int(ok[k].sum()) for k in range(4)])
        i, j, n_digits, groups, letters = i[at], j[at], n_digits[at], groups[at], letters[at]
        inner = {c: v[at] for c, v in inner.items()}
        x = np.zeros((len(at), len(FEATURES)))

        def put(name: str, value: np.ndarray | float) -> None:
            x[:, _F[name]] = value

        put("bias", 1.0)
        for name, least, most in (("digits_below_9", 0, 8), ("digits_9", 9, 9), ("digits_10", 10, 10), ("digits_11", 11, 11), ("digits_12_15", 12, 15), ("digits_16_up", 16, 1 << 30)):
            put(name, (n_digits >= least) & (n_digits <= most))
        a, b = self.n_digits[i], self.n_digits[j]
        check = np.where(b % 2 == 1, self.odd_twice[b] - self.odd_twice[a], self.even_twice[b] - self.even_twice[a])
        put("check_digit", (check % 10 == 0) & (n_digits > 0))
        put("starts_plus", self.first[i] == "+")
        put("starts_parenthesis", self.first[i] == "(")
        put("starts_digit", self.digit[i])
        put("parentheses", inner["("])
        put("hyphens", np.minimum(3, inner["-"]))
        put("blanks", np.minimum(3, inner[" "]))
        put("dots", np.minimum(4, inner["."]))
        put("one_group", groups == 1)
        put("equal_groups", (groups > 1) & (np.abs((self.squares[j] - self.squares[i]) * groups - n_digits.astype(np.float64) ** 2) < 0.5))
        put("groups", np.minimum(8, groups))
        put("octets", self.octets[j] - self.octets[i] == 4)
        before, after = self.before[i], self.after[j]
        further, earlier = self.after[np.minimum(j + 1, self.n)], self.before[np.maximum(i - 1, 0)]
        put("joined_left", self.word_before[i])
        put("joined_right", self.word_after[j])
        put("glued_left", np.isin(before, list("@-_%+=/:")))
        put("glued_right", np.isin(after, list("@-_%+=/")))
        put("dotted_left", (before == ".") & np.isin(earlier, list("0123456789")))
        put("dotted_right", (after == ".") & np.isin(np.array([c[:1] for c in further]), list("0123456789")))
        domain = np.array([bool(kind[m] == EMAIL) and self._dotted(int(i[m]), int(j[m])) for m in range(len(at))], bool)
        put("dotted_domain", domain)
        put("letters", np.minimum(3, letters))
        put("tokens", (j - i) / 10)
        return i, j, kind, x

    def _dotted(self, i: int, j: int) -> bool:
        """Whether a dot stands behind the at sign of a segment."""
        at = i + int(np.nonzero(self.first[i:j] == "@")[0][0])
        return bool(self.count["."][j] > self.count["."][at])


def lattice(island: str) -> Lattice:
    """All candidates of an island."""
    tokens = _Tokens(island)
    return Lattice(tokens.places, *tokens.block(0, tokens.n))


# ---- the model ----

@dataclass
class SpanModel:
    """Weights of whole segments (kinds x features) and of neighbouring labels (5 x 5; the last label is none, of one token each)."""

    segment: np.ndarray
    transition: np.ndarray

    def decode(self, island: str, taken: list[tuple[int, int]], block: int = 2048) -> list[Span]:
        """The best segmentation of an island outside the places `taken`: its entities.

        Segments are made and scored `block` first tokens at a time, and only the last `MAX_TOKENS` rows of scores stay.
        """
        tokens = _Tokens(island)
        n, places, none = tokens.n, tokens.places, len(KINDS)
        edge = np.zeros(n + 1, np.int64)
        for a, b in taken:
            edge[np.searchsorted(places, a, "right") - 1] += 1
            edge[np.searchsorted(places, b, "left")] -= 1
        covered = _sums(np.cumsum(edge)[:n] > 0)
        t, low = self.transition.tolist(), float("-inf")
        # best[i][y]: the best score of the first i tokens with last label y; `back` holds where its last segment starts, and the label before
        best = {0: [low] * none + [0.0]}
        back = array("i", [0, 0] * (none + 1))
        edges: dict[int, list[tuple[int, int, float]]] = {}
        found = False
        for first in range(0, n, block):
            last = min(n, first + block)
            start, stop, kind, x = tokens.block(first, last)
            free = covered[stop] == covered[start]
            scores = (self.segment[kind[free]] * x[free]).sum(axis=1)
            for s, e, k, v in zip(start[free].tolist(), stop[free].tolist(), kind[free].tolist(), scores.tolist()):
                edges.setdefault(e, []).append((s, k, v))
                found = True
            if last == n and not found:
                return []
            for e in range(first + 1, last + 1):
                row, came = [low] * (none + 1), [0, 0] * (none + 1)
                before = best[e - 1]
                y = max(range(none + 1), key=lambda y: before[y] + t[y][none])
                row[none], came[-2:] = before[y] + t[y][none], (e - 1, y)
                for s, k, v in edges.pop(e, ()):
                    before = best[s]
                    for y in range(none + 1):
                        w = before[y] + t[y][k] + v
                        if w > row[k]:
                            row[k], came[2 * k:2 * k + 2] = w, (s, y)
                best[e] = row
                best.pop(e - MAX_TOKENS, None)
                back.extend(came)
        out, e = [], n
        y = max(range(none + 1), key=lambda y: (best[n][y], y))
        while e:
            s, before = back[2 * ((none + 1) * e + y):2 * ((none + 1) * e + y) + 2]
            if y < none:
                out.append((places[s], y, places[e]))
            e, y = s, before
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        """Base spans, and what the model adds beside them; sorted."""
        base = base_spans(text)
        out, at = list(base), 0
        for start, island in islands(text):
            while at < len(base) and base[at][2] <= start:
                at += 1
            taken = [(a - start, b - start) for a, _, b in base[at:_first_from(base, start + len(island))] if b > start]
            out += [(start + a, k, start + b) for a, k, b in self.decode(island, taken)]
        return sorted(out)


def _first_from(spans: list[Span], place: int) -> int:
    """Index of the first span that starts at `place` or later."""
    low, high = 0, len(spans)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if spans[mid][0] < place else (low, mid)
    return low


# ---- training ----

def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _grouped(edges: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges sorted by a key, and where each key begins."""
    edges = edges[np.argsort(key[edges], kind="stable")]
    return edges, np.nonzero(np.diff(key[edges], prepend=-1))[0]


def fit_spans(examples: list[tuple[str, list[Span]]], steps: int = 60, rate: float = 0.15, penalty: float = 1e-3) -> SpanModel:
    """Maximise the penalised conditional likelihood of the segmentations given (Adam); gradients by forward-backward over segments.

    All examples advance together, one token place at a time.
    """
    none, width = len(KINDS), len(FEATURES)
    length, row, start, stop, kind, feats, gold = [], [], [], [], [], [], []
    gold_transition, gold_segment = np.zeros((none + 1, none + 1)), np.zeros((none, width))
    found = sorted([(lattice(island), spans) for island, spans in examples], key=lambda e: -len(e[0].places))
    for r, (part, spans) in enumerate(found):
        want = set(spans)
        own = np.array([(part.places[s], k, part.places[e]) in want for s, e, k in zip(part.start, part.stop, part.kind)], bool)
        length.append(len(part.places) - 1)
        row.append(np.full(len(own), r))
        start.append(part.start), stop.append(part.stop), kind.append(part.kind), feats.append(part.features), gold.append(own)
        np.add.at(gold_segment, part.kind[own], part.features[own])
        at, label, held = 0, none, {int(s): (int(e), int(k)) for s, e, k in zip(part.start[own], part.stop[own], part.kind[own])}
        while at < length[-1]:
            e, k = held.get(at, (at + 1, none))
            gold_transition[label, k] += 1
            at, label = e, k
    lengths = np.array(length)
    row, start, stop, kind, x = np.concatenate(row), np.concatenate(start), np.concatenate(stop), np.concatenate(kind), np.concatenate(feats)
    by_stop, by_start = ([_grouped(np.nonzero(place == t)[0], row * none + kind) for t in range(int(lengths.max()) + 1)] for place in (stop, start))
    live = [int((lengths >= t).sum()) for t in range(int(lengths.max()) + 2)]  # the longest come first
    n, longest, size = len(lengths), int(lengths.max()), none * width
    weights, first, second = np.zeros(size + (none + 1) ** 2), np.zeros(size + (none + 1) ** 2), np.zeros(size + (none + 1) ** 2)
    low = -1e30
    for step in range(1, steps + 1):
        segment, transition = weights[:size].reshape(none, width), weights[size:].reshape(none + 1, none + 1)
        score = (segment[kind] * x).sum(axis=1)
        # ahead[i, t, y]: all ways to label the first t tokens that end with y; into[i, t, k]: those, followed by label k
        ahead, into = np.full((n, longest + 1, none + 1), low), np.full((n, longest + 1, none + 1), low)
        ahead[:, 0, none] = 0.0
        into[:, 0] = _log_sum(ahead[:, 0, :, None] + transition, 1)
        for t in range(1, longest + 1):
            m = live[t]
            ahead[:m, t, none] = into[:m, t - 1, none]
            e, heads = by_stop[t]
            if len(e):
                ahead[row[e[heads]], t, kind[e[heads]]] = np.logaddexp.reduceat(into[row[e], start[e], kind[e]] + score[e], heads)
            into[:m, t] = _log_sum(ahead[:m, t, :, None] + transition, 1)
        # behind[i, t, y]: all ways to label what follows t tokens that end with y; out[i, t, k]: those that begin with label k
        behind, out = np.full((n, longest + 1, none + 1), low), np.full((n, longest + 1, none + 1), low)
        for t in range(longest, -1, -1):
            m = live[t + 1]
            if m:
                out[:m, t, none] = behind[:m, t + 1, none]
                e, heads = by_start[t]
                if len(e):
                    out[row[e[heads]], t, kind[e[heads]]] = np.logaddexp.reduceat(score[e] + behind[row[e], stop[e], kind[e]], heads)
                behind[:m, t] = _log_sum(transition + out[:m, t, None, :], 2)
            behind[m:live[t], t] = 0.0
        norm = _log_sum(ahead[np.arange(n), lengths], 1)
        share = np.exp(into[row, start, kind] + score + behind[row, stop, kind] - norm[row])
        segment_mean = np.zeros((none, width))
        np.add.at(segment_mean, kind, share[:, None] * x)
        pairs = np.zeros((none + 1, none + 1))
        for t in range(longest):
            m = live[t + 1]
            pairs += np.exp(ahead[:m, t, :, None] + transition + out[:m, t, None, :] - norm[:m, None, None]).sum(axis=0)
        gradient = np.concatenate([(gold_segment - segment_mean).ravel(), (gold_transition - pairs).ravel()]) / n - penalty * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return SpanModel(weights[:size].reshape(none, width), weights[size:].reshape(none + 1, none + 1))


def teaching_examples(found: list[tuple[str, list[Span]]], seed: int = 7, joined: int = 300) -> list[tuple[str, list[Span]]]:
    """Islands to learn from: sure ones, their corruptions without entity, and neighbours of several kinds put side by side.

    An island is sure where nothing outside its base spans could be an entity that the base rules missed by where they stop: six
    digits at most are left, and no at sign. Islands without any base span are sure only if letters and digits mix in them.
    """
    rng = random.Random(seed)
    sure: list[tuple[str, list[Span]]] = []
    cores: dict[int, list[str]] = {k: [] for k in range(len(KINDS))}
    for island, spans in found:
        apart = all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))
        rest = list(island)
        for a, _, b in spans:
            rest[a:b] = "\0" * (b - a)
        left = "".join(rest)
        if apart and "@" not in left and (len(digits_of(left)) <= 6 if spans else re.search(r"[0-9][A-Za-z]|[A-Za-z][0-9]", left)):
            sure.append((island, spans))
            for a, k, b in spans:
                cores[k].append(island[a:b])
    pool: list[tuple[str, list[Span]]] = [(core, [(0, k, len(core))]) for k in sorted(cores) for core in cores[k]]
    wrong: list[tuple[str, list[Span]]] = []
    for card in cores[CARD]:
        last = (int(card[-1]) + rng.randint(1, 9)) % 10
        wrong.append((card[:-1] + str(last), []))
    for address in cores[IP]:
        parts = address.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        wrong.append((".".join(parts), []))
        wrong.append((address + "." + str(rng.randint(1, 99)), []))
    for mail in cores[EMAIL]:
        wrong.append((mail[: mail.index("@")] + mail[mail.index("@"):].split(".")[0], []))
    for _ in range(max(60, len(cores[PHONE])) if pool else 0):  # lists of numbers and dates
        numbers = [str(rng.randint(0, 99)) for _ in range(rng.randint(4, 14))]
        date = f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        wrong.append((rng.choice([" ".join(numbers), "-".join(numbers), date, f"{date} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}"]), []))
    for phone in cores[PHONE]:
        wrong.append((digits_of(phone)[: rng.randint(7, 11)], []))
        if "(" in phone:
            bare = phone[phone.index("("):]
            pool.append((bare, [(0, PHONE, len(bare))]))
    parts = pool + wrong
    out = sure + parts
    for _ in range(joined if pool else 0):
        text, spans = "", []
        for island, own in [rng.choice(pool), *rng.choices(parts, k=rng.randint(1, 2))]:
            text += " " if text else ""
            spans += [(len(text) + a, k, len(text) + b) for a, k, b in own]
            text += island
        out.append((text, spans))
    return [(island, spans) for island, spans in out if 0 < len(island) <= 90]


def train_span_model(docs: DataFrame, sample: int = 20_000, per_kind: int = 60) -> SpanModel | None:
    """A model fitted on islands of a bounded sample of documents, labelled by the base rules; None where they find nothing.

    About `sample` documents are chosen by a hash of their texts (equal texts once); of their islands at most `per_kind` that
    start with each base kind, and as many without one, are taken, the first by a hash.
    """
    every = max(1, docs.count() // sample)
    chosen = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(every)) == 0
    some = docs.select("text").filter(chosen & F.col("text").rlike("[0-9]|@")).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds, starts, names, ends = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for start, island in islands(text):
                    if len(island) <= 120:
                        own = [(a - start, k, b - start) for a, k, b in base if start <= a and b <= start + len(island)]
                        texts.append(island), kinds.append(own[0][1] if own else len(KINDS))
                        starts.append([s[0] for s in own]), names.append([s[1] for s in own]), ends.append([s[2] for s in own])
            of = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(kinds, pa.int32()), pa.array(starts, of), pa.array(names, of), pa.array(ends, of)], ["island", "kind", "starts", "names", "ends"])

    found = some.select("text").mapInArrow(labelled, "island string, kind int, starts array<int>, names array<int>, ends array<int>").dropDuplicates(["island"])
    parts = [found.filter(F.col("kind") == k).orderBy(F.xxhash64("island"), "island").limit(per_kind) for k in range(len(KINDS) + 1)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]).collect()
    examples = teaching_examples([(r.island, sorted(zip(r.starts, r.names, r.ends))) for r in sorted(rows, key=lambda r: r.island)])
    return fit_spans(examples) if any(spans for _, spans in examples) else None


# ---- documents ----

_KIND = "array<struct<start:bigint,kind:string,end:bigint,base:boolean>>"


def find_personal_data(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """doc_id, spans: array of (start, kind, end, base) of every row, by start, then kind as listed; code points, end exclusive.

    Base spans are matches of fixed patterns that pass their checks. The model adds segments beside them: within runs of words
    that hold digits or an at sign, every segment of at most `MAX_TOKENS` tokens that has an entity's letters (a number: no part
    of a word) is scored as a whole, and dynamic programming chooses boundaries and kinds together. So numbers that stand side by side are told apart
    where a pattern takes them for one. No added span overlaps a base span. Without a model: base spans alone.

    Null or empty text: no spans. Null doc_id: kept. Repeated rows: each scanned. Equal scores: no entity before an entity.
    Empty table: empty result. Very long texts: whole, in time linear in their length. Other columns are not read.
    """
    narrow = docs.select("doc_id", text_of().alias("text"))
    kind = T.StructType([narrow.schema["doc_id"], T.StructField("spans", T._parse_datatype_string(_KIND))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts, out = batch.column("text"), []
            for at in range(0, batch.num_rows, 500):
                for text in texts.slice(at, 500).to_pylist():
                    base = set(base_spans(text))
                    spans = model.spans(text) if model else sorted(base)
                    out.append([{"start": a, "kind": KINDS[k], "end": b, "base": (a, k, b) in base} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, of)], ["doc_id", "spans"])

    return narrow.mapInArrow(scan, kind)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
