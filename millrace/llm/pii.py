"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The field segments the tokens around digits and @ signs into spans. A span of 1 to
MOST_TOKENS tokens is scored as a whole: its shape, digit count, separators, Luhn sum,
the words before and after it; other tokens are spans of one. Dynamic programming over
(end, length, type), entities bounded in tokens and characters, picks boundaries and
types at once. It is trained here, by gradient ascent on the conditional likelihood
(forward and backward sums over all segmentations).

Examples: windows of a bounded sample of documents in which the fixed patterns mark the
entities. Copies of them are rewritten to forms that the patterns miss (a phone number
without its country code, a card in dotted groups, an address with spaces around its
@), and numbers that are no personal data (years, amounts, versions, dates) are put
in, so that the field learns shapes and contexts beyond the patterns.

Plan: the sample is taken by hash, so many of each kind; a task keeps the first so many of a kind and
sends no more, so what is shuffled is a few hundred rows a task; the weights are small and broadcast; finding spans is one map over whole texts. Text without a digit or @ costs a
search only.

Defined results: a null text is empty and has no span. Positions are code points, ends
exclusive. Pattern spans always stay; the field adds spans that overlap none of them and
beat the reading as plain text by a margin. Without examples the field adds none.
Repeated rows get equal results; extra columns are carried, those with the name of a
result are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready_for_python, slices

#: Kinds in order, with their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_ADDRESS = re.compile(r"^[\w.%+-]+ ?@ ?[\w-]+(?:\.[\w-]+)+[.,;:!?)]*$")
_ANCHOR = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MOST_TOKENS, MOST_CHARS, AROUND, DIM = 5, 48, 3, 1 << 13
MOST_WINDOW, OVERLAP = 512, 2 * MOST_TOKENS + AROUND
O = len(KINDS)  # noqa: E741  the type of plain text


@dataclass(frozen=True)
class Field:
    #: Examples that the field is trained on, at most, of each kind of entity and of plain text, and the most tokens of one.
    sample_windows: int = 80
    sample_tokens: int = 24
    epochs: int = 6
    rate: float = 0.3
    decay: float = 1e-4
    #: Log-odds against plain text that an added span needs.
    margin: float = 3.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):  # from the @ back, so that long runs aren't searched again and again
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    if _ANCHOR.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens (start, end) that reach AROUND tokens to both sides of a digit or @.

    A run of more than MOST_WINDOW tokens comes in parts that share OVERLAP tokens, so that
    a table of numbers of any length takes bounded memory.
    """
    if not _ANCHOR.search(text):
        return
    found, last = [], -10 * AROUND  # the last anchor
    for k, m in enumerate(_TOKEN.finditer(text)):
        found.append((m.start(), m.end()))
        if len(found) > MOST_WINDOW and last >= 0:
            yield found[:-1]
            found = found[-OVERLAP - 1 :]
        if _ANCHOR.search(m[0]):
            last = k
        elif k - last > 2 * AROUND:  # too far from it: its window is over
            keep = AROUND if last >= 0 else 0
            if keep:
                yield found[: len(found) - (k - last) + keep]
                last = -10 * AROUND
            found = found[-AROUND:]
    if last >= 0:
        yield found


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


def _shape(part: str) -> str:
    """Runs of digits and letters as one sign each with the run's length, other signs as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 9)}", part))[:32]


def features(part: str, n_tokens: int, before: str, after: str) -> list[int]:
    """The features of a whole span."""
    d = digits_of(part)
    seen = {c for c in part if not c.isalnum() and c != " "}
    names = [
        "bias",
        f"shape={_shape(part)}",
        f"digits={min(len(d), 20)}",
        f"signs={''.join(sorted(seen))[:8]}",
        f"tokens={n_tokens}",
        f"letters={any(c.isalpha() for c in part)}",
        f"ends={part[0] if not part[0].isalnum() else 'x'}{part[-1] if not part[-1].isalnum() else 'x'}",
        f"before={before.lower()[:12]}",
        f"after={after.lower()[:12]}",
    ]
    if len(d) >= 12:
        names.append(f"luhn={luhn(d)},{14 <= len(d) <= 19}")
    if "@" in part:
        names.append(f"address={bool(_ADDRESS.search(part))}")
    if part.count(".") == 3:
        names.append(f"octets={all(p.isdigit() and int(p) <= 255 for p in part.split('.') if len(p) < 5)}")
    return [_slot(x) for x in names]


def lattice(text: str, tokens: list[tuple[int, int]]) -> list[list[list[int] | None]]:
    """[end token][length - 1]: features of the span, or None where it is too long or has no @ and no digit at an end."""
    words, out = [text[a:b] for a, b in tokens], []
    for end in range(len(tokens)):
        row: list[list[int] | None] = []
        for n in range(1, min(MOST_TOKENS, end + 1) + 1):
            a, b = tokens[end - n + 1][0], tokens[end][1]
            before, after = words[end - n] if end >= n else "", words[end + 1] if end + 1 < len(words) else ""
            if b - a > MOST_CHARS:  # too long for an entity; a single token is still plain text
                row += [[_slot("long")]] if n == 1 else [None]
            else:
                part = text[a:b].replace("\n", " ")
                row.append(features(part, n, before, after) if n == 1 or "@" in part or _ANCHOR.search(words[end]) and _ANCHOR.search(words[end - n + 1]) else None)
        out.append(row)
    return out


def scores(weights: np.ndarray, grid: list[list[list[int] | None]], tokens: list[tuple[int, int]]) -> np.ndarray:
    """[end, length - 1, type]: minus infinity where a span can't be of the type."""
    out = np.full((len(grid), MOST_TOKENS, O + 1), -np.inf)
    for end, row in enumerate(grid):
        for n, found in enumerate(row):
            if found is not None:
                out[end, n] = weights[:, found].sum(axis=1)
                if n:
                    out[end, n, O] = -np.inf
                elif tokens[end][1] - tokens[end][0] > MOST_CHARS:
                    out[end, n, :O] = -np.inf
    return out


def _lse(x: np.ndarray, axis) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(s: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each span and type, and expected counts of type pairs, by forward and backward sums."""
    n, types = len(s), O + 1
    ahead, back = np.full((n + 1, types), -np.inf), np.full((n + 1, types), -np.inf)
    ahead[0, O], back[n] = 0.0, 0.0  # a window starts as after plain text
    with np.errstate(divide="ignore"):
        into = np.full((n + 1, types), -np.inf)
        for t in range(n):
            into[t] = _lse(ahead[t][:, None] + moves, 0)
            k = min(MOST_TOKENS, t + 1)
            ahead[t + 1] = _lse(np.stack([into[t - j] + s[t, j] for j in range(k)]), 0)
        for t in range(n - 1, -1, -1):
            k = min(MOST_TOKENS, n - t)
            out = _lse(np.stack([s[t + j, j] + back[t + 1 + j] for j in range(k)]), 0)
            back[t] = _lse(moves + out[None, :], 1)
        z = _lse(ahead[n], 0)
        p, pairs = np.zeros_like(s), np.zeros((types, types))
        for t in range(n):
            for j in range(min(MOST_TOKENS, t + 1)):
                p[t, j] = np.exp(into[t - j] + s[t, j] + back[t + 1] - z)
                pairs += np.exp(ahead[t - j][:, None] + moves + (s[t, j] + back[t + 1])[None, :] - z)
    return p, pairs


def decode(s: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, type, last token) of the best segmentation's entities."""
    n = len(s)
    best, how = np.full((n + 1, O + 1), -np.inf), np.zeros((n + 1, O + 1, 2), np.int64)
    best[0, O] = 0.0
    into, come = np.full((n, O + 1), -np.inf), np.zeros((n, O + 1), np.int64)
    for t in range(n):
        reach = best[t][:, None] + moves
        into[t], come[t] = reach.max(axis=0), reach.argmax(axis=0)
        k = min(MOST_TOKENS, t + 1)
        x = np.stack([into[t - j] + s[t, j] for j in range(k)])
        j = x.argmax(axis=0)
        best[t + 1] = x[j, np.arange(O + 1)]
        how[t + 1, :, 0], how[t + 1, :, 1] = j + 1, come[t - j, np.arange(O + 1)]
    out, t, y = [], n, int(best[n].argmax())
    while t > 0:
        length, before = how[t, y]
        if y != O:
            out.append((t - int(length), y, t - 1))
        t, y = t - int(length), int(before)
    return out[::-1]


class Clear:
    """Whether no span overlaps a range; spans come sorted by start."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [x for x, _, _ in spans]
        self.ends = list(accumulate((y for _, _, y in spans), max))

    def __call__(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b)
        return not n or self.ends[n - 1] <= a


@dataclass
class Crf:
    weights: np.ndarray  # [type, feature]
    moves: np.ndarray  # [type before, type]
    margin: float

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the entities that overlap no span of base."""
        out, clear = [], Clear(base)
        for tokens in windows(text):
            s = scores(self.weights, lattice(text, tokens), tokens)
            for first, kind, last in decode(s, self.moves):
                if s[last, last - first, kind] - s[first : last + 1, 0, O].sum() < self.margin:
                    continue
                a, b = tokens[first][0], tokens[last][1]
                while b > a and text[b - 1] in ".,;:!?\"')":
                    b -= 1
                if b > a and clear(a, b) and (not out or out[-1][2] <= a):  # parts of a long window share tokens
                    out.append((a, kind, b))
        return out


_PLAIN = ("2019", "1,250", "3.5", "2.0", "v1.2.3", "2021-05-03", "12:30", "100%", "$45.00", "#1234", "10/12/2020", "page 12", "1984", "42", "ISO-9001", "12345", "3rd", "7", "0.25", "1.000.000")


def rewritten(kind: int, part: str, pick: int) -> str:
    """A form of the entity that the patterns miss."""
    d = digits_of(part)
    if kind == 0:
        local, _, domain = part.partition("@")
        return (f"{local} @ {domain}", f"{local} @{domain}", f"{local}@ {domain}")[pick % 3]
    if kind == 2:
        cut = [d[i : i + 4] for i in range(0, len(d), 4)]
        return (".".join(cut), "/".join(cut))[pick % 2]
    if kind == 3 and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")[pick % 4]
    return part


Example = tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]


def examples(text: str, most_tokens: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Short texts with their entities: windows as they are, rewritten, and with plain numbers put in."""
    base = base_spans(text)
    free, starts = Clear(base), [x for x, _, _ in base]
    for tokens in windows(text):
        tokens = tokens[:most_tokens]
        a, b = tokens[0][0], tokens[-1][1]
        if not free(a, a) or not free(b, b):
            continue  # an entity lies across an end
        inside = base[bisect_left(starts, a) : bisect_left(starts, b)]
        if not inside and ("@" in text[a:b] or len(digits_of(text[a:b])) >= 7):
            continue  # it may hold an entity that the patterns miss: no example of plain text
        clear = [x for k, x in enumerate(inside) if all(x[2] <= y[0] or y[2] <= x[0] for y in inside[:k])]
        yield text[a:b], [(x - a, k, y - a) for x, k, y in clear]
        pick, new, spans, at = zlib.crc32(text[a:b].encode()), "", [], a
        for x, k, y in clear:
            new += text[at:x]
            form = rewritten(k, text[x:y], pick)
            spans.append((len(new), k, len(new) + len(form)))
            new, at = new + form, y
        new += text[at:b]
        plain = _PLAIN[pick % len(_PLAIN)]
        yield f"{new} {plain} {_PLAIN[pick // 31 % len(_PLAIN)]} {text[a:b].split()[0] if not clear else 'x'}"[: len(new) + 40], spans


def spark_hash(x: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(x.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def sample_rows(docs: DataFrame, text: str, f: Field) -> DataFrame:
    """(x, spans, kind): of each task's examples those with the smallest hashes, f.sample_windows of each kind at most."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, set[tuple]] = {}  # by kind, in the order that the rows are ranked in below

        def cut(kept: set[tuple]) -> set[tuple]:
            return set(sorted(kept)[: f.sample_windows])

        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).to_pylist():
                    for x, spans in examples(t, f.sample_tokens) if t else ():
                        if len(x) <= 40 * f.sample_tokens:
                            kept = best.setdefault(spans[0][1] if spans else O, set())
                            kept.add((spark_hash(x), x, json.dumps(spans, separators=(",", ":"))))
                            if len(kept) > 8 * f.sample_windows:
                                best[spans[0][1] if spans else O] = cut(kept)
        rows = [(x, json.loads(spans), k) for k, kept in best.items() for _, x, spans in cut(kept)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in rows], pa.string()), pa.array([y for _, y, _ in rows], pa.list_(pa.list_(pa.int32()))), pa.array([k for _, _, k in rows], pa.int32())], names=["x", "spans", "kind"])

    return docs.select(text).where(F.col(text).rlike("[0-9@]")).mapInArrow(sample, "x string, spans array<array<int>>, kind int")


def fit(docs: DataFrame, text: str, f: Field) -> Crf | None:
    """The field, from the examples with the smallest hashes of all: f.sample_windows of each kind at most."""
    first = Window.partitionBy("kind").orderBy(F.xxhash64("x"), "x", F.to_json("spans"))
    ranked = sample_rows(docs, text, f).distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= f.sample_windows)
    chosen = ranked.orderBy(F.xxhash64("x"), "x", F.to_json("spans")).collect()  # at most sample_windows of each of five kinds
    ready = []
    for row in chosen:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(row["x"])]
        if not tokens:
            continue
        by_start = {a: (k, b) for a, k, b in row["spans"]}
        gold, t = [], 0
        while t < len(tokens):
            # An entity covers the tokens that it touches; punctuation at its end belongs to its token.
            hit = next(((k, b) for a, (k, b) in by_start.items() if tokens[t][0] <= a < tokens[t][1]), None)
            last = t
            while hit and last + 1 < len(tokens) and tokens[last + 1][0] < hit[1]:
                last += 1
            good = hit and last - t < MOST_TOKENS and tokens[last][1] - tokens[t][0] <= MOST_CHARS
            gold.append((t, hit[0], last) if good else (t, O, t))
            t = last + 1 if good else t + 1
        grid = lattice(row["x"], tokens)
        if all(grid[b][b - a] is not None for a, _, b in gold):
            ready.append((grid, tokens, gold))
    if not ready:
        return None
    weights, moves = np.zeros((O + 1, DIM)), np.zeros((O + 1, O + 1))
    square, square_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    for _ in range(f.epochs):
        for grid, tokens, gold in ready:
            p, pairs = marginals(scores(weights, grid, tokens), moves)
            step, move, before = np.zeros_like(p), -pairs, O
            for a, k, b in gold:
                step[b, b - a, k] += 1
                move[before, k] += 1
                before = k
            step -= p
            slots = np.array([x for row in grid for found in row if found is not None for x in found])
            amount = np.concatenate([np.repeat(step[e, n][:, None], len(found), axis=1) for e, row in enumerate(grid) for n, found in enumerate(row) if found is not None], axis=1)
            used, inverse = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=amount[k], minlength=len(used)) for k in range(O + 1)]) - f.decay * weights[:, used]
            square[:, used] += g * g
            weights[:, used] += f.rate * g / np.sqrt(square[:, used])
            square_m += move * move
            moves += f.rate * move / np.sqrt(square_m)
    return Crf(weights, moves, f.margin)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"


def find_personal_data(docs: DataFrame, text: str = "text", f: Field = Field()) -> DataFrame:
    """docs with the columns of RESULT; base and spans are kind:start:end, comma-joined."""
    ready_for_python(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    carried = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in carried])
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text, f))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for x in part.column(text).to_pylist():
                    base = base_spans(x or "")
                    added = crf.spans(x, base) if crf and x else []
                    rows.append((*(sum(k == kind for _, kind, _ in base) for k in range(O)), joined(base), joined(sorted(base + added)), len(added)))
                columns = [pa.array(x, pa.string() if k in (4, 5) else pa.int64()) for k, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + columns, names=carried + names)

    return docs.mapInArrow(find, T.StructType(docs.schema.fields + T.StructType.fromDDL(RESULT).fields))
