"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

All of it is Spark SQL functions: one projection over the documents, no shuffle, no
Python. Positions come from the pieces between matches: a match starts where the pieces
and matches before it end. Candidates for the entropy are runs of token characters. A
window slides over a candidate with its character counts held in an array; each step
changes two counts and the sum of c * log2(c), so the entropy costs the same at any
window length. Arrays that grow do so in parts of bounded size, and long runs are slid over
in chunks that overlap, so the cost is in proportion to the text. Limits depend on the class of the candidate's characters. What a fixed
pattern or the allow list covers is blanked before, so that the rest of its run is
scanned; windows over the limit that don't touch are spans of their own.

Defined results: a null text is empty and has no span. Positions are code points, ends
exclusive. A run of any length is scanned whole. Repeated rows get equal results; extra
columns are carried, those with the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order, with their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "array<struct<start:int,rank:int,end:int>>"
#: The signs of candidates in ASCII lie from + to z.
FIRST_SIGN, SIGNS = ord("+"), ord("z") - ord("+") + 1
#: Elements of an array that is appended to, and characters that one fold slides over.
PART, CHUNK = 512, 4096


@dataclass(frozen=True)
class Entropy:
    window: int = 20
    #: Character class of the whole candidate, and the least bits a character in a window: the first that fits holds.
    #: At most 5 % of random tokens of 20 characters of a class lie below its limit, save where words reach
    #: as far: letters of one case, humps (CamelCase), and what separators join.
    limits: tuple[tuple[str, float], ...] = (
        (r"^[0-9+/_=-]+$", 2.65),
        (r"^[A-Z]?[a-z]+$|^[A-Z]+$", 3.8),
        (r"^[A-Z]?[a-z+/_=-]+$|^[A-Z+/_=-]+$", 4.1),
        (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
        (r"^[A-Z0-9]+$|^[a-z0-9]+$", 3.5),
        (r"^[a-z]*([A-Z][a-z]{2,})+$", 4.1),
        (r"^[A-Za-z]+$", 3.65),
        (r"^[^0-9]+$", 4.1),
        (r"", 3.7),
    )
    #: What a match of one of these covers is no secret: a listed word with up to 64 letters and digits on each side, and a UUID.
    allow: tuple[str, ...] = (r"[0-9a-z]{0,64}(?:example|0123456789|abcdefghij)[0-9a-z]{0,64}", r"(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])")

    @property
    def candidate(self) -> str:
        return r"[A-Za-z0-9+/_=-]{%d,}" % self.window


def _let(value: Column, then) -> Column:
    """then(value), with value computed once: what a lambda captures is computed anew for each of its elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _groups(items: Column) -> Column:
    """An array in parts of PART, so that appending to an array costs no more than that, however many there are."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / PART).cast("int") - 1, F.lit(0))), lambda g: F.slice(items, g * PART + 1, PART))


def _running(values: Column, kind: str, start: Column, add) -> Column:
    """What is before each value: start, add(start, value), and so on; an array as long as values."""
    zero = F.struct(start.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    return F.aggregate(values, zero, lambda s, x: F.struct(add(s["at"], x).cast(kind).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])


def _walk(text: Column, pattern: str, to_rows) -> Column:
    """to_rows(matches): of each match, in order, a (its start) and w (its text)."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, w: F.struct(b.alias("b"), w.alias("w")))
    pairs = F.filter(pairs, lambda x: x["w"].isNotNull())  # the last piece is behind the last match
    total = lambda at, x: at + x["b"] + F.length(x["w"])

    def starts(groups: Column) -> Column:
        sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), total))
        firsts = _running(sums, "int", F.lit(0), lambda at, x: at + x)
        each = lambda g, at: F.zip_with(g, _running(g, "int", at, total), lambda x, a: F.struct((a + x["b"]).alias("a"), x["w"].alias("w")))
        return F.flatten(F.zip_with(groups, firsts, each))

    found = _let(pairs, lambda p: _let(_groups(p), starts))
    return F.when(text.rlike(pattern), to_rows(found)).otherwise(F.array().cast(_SPAN))


def pattern_spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the matches whose group has this many characters at least."""

    def rows(matches: Column) -> Column:
        if group:
            matches = F.filter(matches, lambda x: F.length(F.regexp_extract(x["w"], pattern, group)) >= least)
        return F.transform(matches, lambda x: F.struct(x["a"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["a"] + F.length(x["w"])).alias("end"))).cast(_SPAN)

    return _walk(text, pattern, rows)


_PARTS = "array<struct<first:int,last:int>>"


def touching(parts: Column) -> Column:
    """(first, last) stretches in order, those that touch made one."""
    pair = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))

    def step(state: Column, x: Column) -> Column:
        new = state["open"].isNotNull() & (state["open"]["last"] < x["first"])
        done = F.when(new, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(new | state["open"].isNull(), pair(x["first"], x["last"])).otherwise(pair(state["open"]["first"], x["last"])).alias("open"))

    none = F.lit(None).cast("struct<first:int,last:int>")
    return F.aggregate(parts, F.struct(F.array().cast(_PARTS).alias("done"), none.alias("open")), step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def hot_parts(candidate: Column, limit: Column, e: Entropy) -> Column:
    """(first, last) of each stretch of touching windows whose entropy reaches the limit."""
    # n * log2(n) for counts of 0 to window + 1.
    table = F.array(*[F.lit(n * log2(n) if n else 0.0) for n in range(e.window + 2)])

    def bump(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, 1, code), F.array(F.get(counts, code) + by), F.slice(counts, code + 2, SIGNS))

    def step(state: Column, x: Column) -> Column:
        i, code, left = state["i"], x["code"], x["left"]
        n = F.get(state["counts"], code)
        grown, sums = bump(state["counts"], code, 1), state["s"] + F.get(table, n + 1) - F.get(table, n)
        m = F.get(grown, left)
        full = left.isNotNull()
        counts = F.when(full, bump(grown, left, -1)).otherwise(grown)
        s = F.when(full, sums + F.get(table, m - 1) - F.get(table, m)).otherwise(sums)
        hot = (i >= e.window - 1) & (F.lit(log2(e.window)) - s / e.window >= limit)
        first = i - (e.window - 1)
        new = hot & (state["last"].isNull() | (state["last"] < first))  # a stretch that the open one doesn't touch
        closed = new & state["last"].isNotNull()
        done = F.when(closed, F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), state["last"].alias("last"))))).otherwise(state["done"])
        return F.struct(
            (i + 1).alias("i"),
            counts.alias("counts"),
            s.alias("s"),
            F.when(new, first).otherwise(state["first"]).alias("first"),
            F.when(hot, i + 1).otherwise(state["last"]).alias("last"),
            done.alias("done"),
        )

    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), SIGNS).alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"), F.array().cast(_PARTS).alias("done"))

    def all_parts(state: Column) -> Column:
        return F.when(state["last"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), state["last"].alias("last")))))

    def of_chunk(chunk: Column) -> Column:
        codes = F.transform(F.split(chunk, ""), lambda c: F.ascii(c) - FIRST_SIGN)
        # The sign that comes in, and the one that goes out then.
        moves = _let(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(none, e.window), c), 1, F.size(c)), lambda code, left: F.struct(code.alias("code"), left.alias("left"))))
        return F.aggregate(moves, zero, step, all_parts)

    # Chunks that overlap by a window less one: each window is in one of them.
    keep = e.window - 1
    chunks = F.regexp_extract_all(candidate, F.lit(".{1,%d}" % CHUNK), F.lit(0))
    apart = _let(chunks, lambda c: F.zip_with(c, F.slice(F.concat(F.array(F.lit("")), F.transform(c, lambda x: F.right(x, F.lit(keep)))), 1, F.size(c)), lambda x, tail: F.concat(tail, x)))
    shifted = F.transform(apart, lambda x, i: F.transform(of_chunk(x), lambda h: F.struct((h["first"] + F.greatest(i * CHUNK - keep, F.lit(0))).alias("first"), (h["last"] + F.greatest(i * CHUNK - keep, F.lit(0))).alias("last"))))
    return touching(F.flatten(shifted))


def blanked(text: Column, spans: Column) -> Column:
    """text with spaces in place of what the spans, in order of their starts, cover."""

    def whole(groups: Column) -> Column:
        # Of each group: where it begins (the spans before it may reach into it) and where the next one does.
        ends = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda x: x["end"])))
        covered = _running(ends, "int", F.lit(0), lambda at, x: F.greatest(at, x))
        begins = F.transform(groups, lambda g, i: F.when(i == 0, F.lit(0)).otherwise(F.get(g, F.lit(0))["start"]))
        frames = F.transform(F.arrays_zip(groups.alias("g"), covered.alias("at"), begins.alias("a"), F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.length(text))).alias("b")), of_group)
        return F.array_join(frames, "")

    def of_group(x: Column) -> Column:
        a, b = x["a"], x["b"]

        def step(state: Column, span: Column) -> Column:
            at = state["at"]
            start, end = F.least(F.greatest(at, span["start"] - a), b - a), F.least(span["end"] - a, b - a)
            more = F.array(F.substring(state["t"], at + 1, start - at), F.repeat(F.lit(" "), F.greatest(end - start, F.lit(0))))
            return F.struct(state["t"].alias("t"), F.greatest(at, end, start).alias("at"), F.concat(state["out"], more).alias("out"))

        into = F.greatest(F.least(x["at"], b) - a, F.lit(0))  # covered by spans of the groups before
        zero = F.struct(F.substring(text, a + 1, b - a).alias("t"), into.alias("at"), F.array(F.repeat(F.lit(" "), into)).alias("out"))
        return F.aggregate(x["g"], zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(s["t"], s["at"] + 1, b - a)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_groups(spans), whole))


def open_text(text: Column, base: Column, e: Entropy) -> Column:
    """text without what base or the allow list covers; empty if it has no candidate at all."""
    allowed = pattern_spans(text, "entropy", f"(?i)(?:{'|'.join(e.allow)})")
    return F.when(text.rlike(e.candidate), _let(F.array_sort(F.concat(base, allowed)), lambda spans: blanked(text, spans))).otherwise("")


def entropy_spans(text: Column, e: Entropy) -> Column:
    """Spans of high entropy in an open_text."""

    def limit(x: Column) -> Column:
        out = None
        for pattern, bits in e.limits:
            out = F.when(x.rlike(pattern), bits) if out is None else out.when(x.rlike(pattern), bits)
        return out

    def rows(matches: Column) -> Column:
        runs = F.transform(matches, lambda x: F.struct(x["a"].alias("a"), x["w"].alias("w"), limit(x["w"]).alias("least")))
        found = F.flatten(F.transform(runs, lambda x: F.transform(hot_parts(x["w"], x["least"], e), lambda h: F.struct((x["a"] + h["first"]).alias("start"), (x["a"] + h["last"]).alias("end")))))
        return F.transform(found, lambda x: F.struct(x["start"], F.lit(KINDS.index("entropy")).alias("rank"), x["end"])).cast(_SPAN)

    return _walk(text, e.candidate, rows)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", e: Entropy = Entropy()) -> DataFrame:
    """docs with base and all: arrays of (start, rank of the kind, end), by start and kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(pattern_spans(whole, "assign", ASSIGN, 2, 6), pattern_spans(whole, "access", ACCESS), pattern_spans(whole, "hex", HEX)))
    found = docs.withColumn("base", base)
    found = found.withColumn("__open", open_text(whole, F.col("base"), e))
    return found.withColumn("all", F.array_sort(F.concat("base", entropy_spans(F.col("__open"), e)))).drop("__open")
