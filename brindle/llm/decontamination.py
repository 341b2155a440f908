"""Benchmark decontamination by template windows.

1. Texts become templates: numbers, units after numbers and names (capitalised
   words inside a sentence, a run of them as one) are replaced by typed
   placeholders; other words are lower-cased. A token's canonical form is worked
   out once per distinct token.
2. Windows of WINDOW template words are hashed. A bit table of fixed size, made
   from the benchmark's windows, lets a document's other windows go before any
   shuffle; what passes by chance falls in the hash join.
3. Matched windows are grouped by alignment (place in the document less place
   in the item). Where an alignment fills slots, the map from the item's values
   to the document's must be one-to-one, or the alignment does not count: a
   question with other numbers is caught, another that only shares the template
   words is not. A name's value is its last word. Windows that take a sentence's
   first word for a name count where the map with theirs is one-to-one; if it is
   not, the alignment's others still count by their own map.
4. A document holds an item if distinct windows of alignments that count cover
   COVERAGE of the item's.

A capitalised word that opens a sentence may be a name, or part of the name that
follows: windows that hold one are taken each way, in items and documents. Windows
that hold names are also taken with their words, so that copies in other case are
found.

Defined results: null and empty texts and items hold nothing; very long texts are
read whole, a part at a time; ties do not arise; empty tables give no rows; an item with
fewer words than a window is one window, and so is found only in documents of
at least as many words; repeated rows of a document give one result row; a null
doc_id or item_id is a value like any other. Extra columns are kept by
decontaminate(), not read by the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import written

#: Template words of a window; the share of an item's windows that make a hit; bits of the table.
WINDOW, COVERAGE, TABLE_BITS = 5, 0.8, 1 << 24
#: Words that are units where they follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yards mile miles mg g kg lb lbs oz pounds ounces grams ml l liters litres gallons "
    "s sec secs min mins h hr hrs seconds minutes hours days weeks months years dollars cents euros usd eur percent degrees mph kph hz khz mhz ghz kb mb gb tb w kw v".split()
)
_PART = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?:;]\W*$")
_WORD, _NUMBER, _UNIT, _CAPITAL = range(4)
_MULT = 0x9E3779B97F4A7C15
#: Tokens handled at once, and remembered.
_TOKENS, _KNOWN = 1 << 18, 1 << 20
#: Windows whose other readings are made at once, and rows given out together.
_STARTS = 1 << 13


def _h(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 0)


_SLOT = np.array([0, _h("\0number"), _h("\0unit"), _h("\0name")], np.uint64)


def _powers() -> np.ndarray:
    out = [1]
    for _ in range(WINDOW):
        out.append(out[-1] * _MULT % 2**64)
    return np.array(out, np.uint64)


_POWERS = _powers()
_NAMES = _SLOT[3] * _POWERS


class Tokens(dict):
    """The number of each raw token (a run of anything but white space); its parts lie in flat lists."""

    def __init__(self) -> None:
        super().__init__()
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.at: list[int] = [0]
        self.value: list[int] = []
        self.kind: list[int] = []
        self.ends: list[bool] = []
        self.stops: list[bool] = []

    def __missing__(self, raw: str) -> int:
        for part in _PART.findall(raw):
            low = part.lower()
            self.value.append(_h(low))
            self.kind.append(_NUMBER if part[0].isdigit() else _UNIT if low in UNITS else _CAPITAL if part[0].isupper() else _WORD)
            self.ends.append(False)
            self.stops.append(False)
        if self.at[-1] < len(self.value):
            self.ends[-1] = bool(_END.search(raw))
            self.stops[-1] = not raw[-1].isalnum()
        number = self[raw] = len(self.at) - 1
        self.at.append(len(self.value))
        return number


@dataclass
class _Nodes:
    """What windows are made of, a text after another: form (what is hashed), value (of a slot; 0: a word), stop (end of the
    node's text), first (of its text); other: may be read as a name, whose value and next node are other_value and other_next."""

    form: np.ndarray
    value: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    other: np.ndarray
    other_value: np.ndarray
    other_next: np.ndarray

    def windows(self, starts: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Of all readings of the windows from some nodes on: start, hash, slots' values, whether another reading is taken."""
        n = len(self.form)
        whole = starts + WINDOW <= self.stop[starts]
        padded = np.concatenate([self.form, np.zeros(WINDOW, np.uint64)])
        total = padded[:n] * _POWERS[0]
        for j in range(1, WINDOW):
            total += padded[j : j + n] * _POWERS[j]
        plain = starts[whole]
        hashes = _mixed(total[plain], np.uint64(WINDOW))
        good = _in_table(hashes, bits)
        plain, hashes = plain[good], hashes[good]
        found = [(plain, hashes, self._fills(plain, np.full(len(plain), WINDOW), np.zeros(len(plain), np.int64)), np.zeros(len(plain), bool))]
        # Those that may be read otherwise, and texts shorter than a window, which are one.
        seen = np.concatenate(([0], np.cumsum(self.other)))
        two_ways = seen[np.minimum(starts + WINDOW, n)] > seen[starts]
        rest = starts[np.where(whole, two_ways, self.first[starts])]
        found += [self._others(rest[lo : lo + _STARTS], bits) for lo in range(0, len(rest), _STARTS)]
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def _others(self, start: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
        n, at = len(self.form), start
        total, width, taken = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for j in range(WINDOW):
            live = at < self.stop[start]
            node = np.minimum(at, n - 1)
            two = np.flatnonzero(live & self.other[node])
            also = start[two], self.other_next[node[two]], total[two] + _NAMES[j], width[two] + 1, taken[two] | (1 << j)
            total = total + np.where(live, self.form[node] * _POWERS[j], np.uint64(0))
            width, at = width + live, at + live
            if len(two):
                start, at, total, width, taken = (np.concatenate(x) for x in zip((start, at, total, width, taken), also, strict=True))
        hashes = _mixed(total, width.astype(np.uint64))
        good = np.where(width == WINDOW, (taken > 0) | (start + WINDOW > self.stop[start]), self.first[start])
        good &= _in_table(hashes, bits)
        start, hashes, width, taken = start[good], hashes[good], width[good], taken[good]
        return start, hashes, self._fills(start, width, taken), taken > 0

    def _fills(self, start: np.ndarray, width: np.ndarray, taken: np.ndarray) -> np.ndarray:
        fills, at = np.zeros((len(start), WINDOW), np.uint64), start
        for j in range(WINDOW):
            node, is_other = np.minimum(at, len(self.form) - 1), (taken >> j) & 1 > 0
            fills[:, j] = np.where(j < width, np.where(is_other, self.other_value[node], self.value[node]), np.uint64(0))
            at = np.where(is_other, self.other_next[node], node + 1)
        return fills


def _mixed(total: np.ndarray, width: np.ndarray) -> np.ndarray:
    total = (total ^ width) * _POWERS[1]
    return total ^ (total >> np.uint64(29))


def _in_table(hashes: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    spot = (hashes & np.uint64(TABLE_BITS - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0


def _windows(texts: list[str], tokens: Tokens, bits: np.ndarray | None, items: bool) -> tuple[np.ndarray, ...]:
    """Of all windows of some texts: text, place, hash, the slots' values (0: a word), and loose (a first word read as a name), a row per window and reading.

    items: only windows that are whole in each reading, so that a place counts only where every copy can match it.
    """
    if len(tokens) > _KNOWN:
        tokens._reset()
    raw = [np.fromiter(map(tokens.__getitem__, words), np.int64, len(words)) for words in map(str.split, texts)]
    flat = np.concatenate([*raw, np.empty(0, np.int64)])
    at = np.array(tokens.at)
    begin, size = at[flat], at[flat + 1] - at[flat]
    part = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1]))[: len(size)], size) + np.arange(size.sum())
    value = np.array(tokens.value, np.uint64)[part]
    kind = np.array(tokens.kind, np.int64)[part]
    ends = np.array(tokens.ends, bool)[part]
    stops = np.array(tokens.stops, bool)[part]
    text = np.repeat(np.repeat(np.arange(len(texts)), [len(r) for r in raw]), size)
    n = len(value)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), np.empty((0, WINDOW), np.uint64), none.astype(bool)
    new = np.concatenate(([True], text[1:] != text[:-1]))
    opens = new | np.concatenate(([False], ends[:-1]))
    after_number = ~new & np.concatenate(([False], kind[:-1] == _NUMBER))
    slot = np.where(kind == _NUMBER, 1, np.where((kind == _UNIT) & after_number, 2, np.where((kind == _CAPITAL) & ~opens, 3, 0)))
    name, capital = slot == 3, kind == _CAPITAL
    # A place is a word, or a run of capitalised ones that may be one name.
    joined = name & np.concatenate(([False], capital[:-1] & ~stops[:-1]))
    place = np.cumsum(~joined) - 1
    length = np.bincount(text[~joined], minlength=len(texts))
    place -= (np.cumsum(length) - length)[text]
    countable = (length[text] - place >= WINDOW) | (place == 0) if items else np.ones(n, bool)
    # Names as slots; of a run, its first word apart if that opens a sentence.
    head = np.flatnonzero(~(joined & np.concatenate(([False], name[:-1]))))
    m = len(head)
    last = np.append(head[1:], n) - 1
    stop = np.searchsorted(text[head], text[head], side="right")
    before_run = np.append(joined[head[1:]], False)
    after = np.arange(m) + 1
    other = capital[head] & opens[head]
    held = np.where(slot[head] > 0, value[last], np.uint64(0))
    nodes = _Nodes(np.where(slot[head] > 0, _SLOT[slot[head]], value[head]), held, stop, new[head], other, value[last[np.minimum(np.arange(m) + before_run, m - 1)]], after + before_run)
    start, hashes, fills, loose = nodes.windows(np.flatnonzero(countable[head]), bits)
    start = head[start]
    # Names as words, for windows that hold one.
    bare = np.where(name, 0, slot)
    stop = np.searchsorted(text, text, side="right")
    seen = np.concatenate(([0], np.cumsum(name)))
    holds = seen[np.minimum(np.arange(n) + WINDOW, stop)] > seen[:-1]
    none = np.zeros(n, bool)
    words = _Nodes(np.where(bare > 0, _SLOT[bare], value), np.where(bare > 0, value, np.uint64(0)), stop, new, none, value, stop)
    more = words.windows(np.flatnonzero(holds & countable), bits)
    start, hashes, fills, loose = (np.concatenate(x) for x in zip((start, hashes, fills, loose), more, strict=True))
    return text[start], place[start], hashes, fills, loose


def _emitter(ids: list[str], table: bytes | None):  # noqa: ANN202
    """Windows as rows: the columns ids, place, hash, slots, loose; only those in the table, if there is one."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if table is None else np.frombuffer(table, np.uint8)
        tokens = Tokens()
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            size = np.cumsum([len(t) for t in texts])
            cuts = np.searchsorted(size, np.arange(0, size[-1] + 1, 6 * _TOKENS), side="right") if len(texts) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                text, place, hashes, fills, loose = _windows(texts[lo:hi], tokens, bits, items=bits is None)
                rows = batch.iloc[lo:hi][ids]
                for k in range(0, len(text), _STARTS):
                    some = slice(k, k + _STARTS)
                    out = rows.iloc[text[some]].reset_index(drop=True)
                    yield out.assign(place=place[some], hash=hashes[some].view(np.int64), slots=pd.Series(list(fills[some].view(np.int64)), dtype=object), loose=loose[some])

    return emit


def item_windows(items: DataFrame) -> DataFrame:
    """item, place, hash, slots, loose, n (windows of the item): a row per window and reading of each distinct item."""
    named = items.select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text")).filter("text is not null")
    rows = named.select("item_id", "item", "text").mapInPandas(_emitter(["item_id", "item"], None), "item_id long, item long, place long, hash long, slots array<long>, loose boolean")
    rows = written(rows, "windows")
    # A place counts once, whichever way its windows match.
    sizes = rows.groupBy("item").agg(F.countDistinct("place").alias("n"))
    return written(rows.join(sizes, "item"), "items")


def bit_table(windows: DataFrame) -> bytes:
    """TABLE_BITS bits, those of the windows' hashes set. Tasks set them, 64 at once; TABLE_BITS / 64 numbers at most go to the driver."""
    spot = F.pmod(F.col("hash"), F.lit(TABLE_BITS)).cast("int")
    one = F.expr(f"shiftleft(1L, CAST(pmod(hash, {TABLE_BITS}) AS INT) & 63)")
    words = windows.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    table = np.zeros(TABLE_BITS // 64, "<i8")
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.tobytes()


def rare_windows(theirs: DataFrame, coverage: float) -> DataFrame:
    """hash and item of the windows of each item by which its copies are sought.

    A document that holds coverage of an item's places has one at least of any
    set that is larger than the rest; the places whose windows the fewest items
    share make the fewest candidates.
    """
    often = theirs.groupBy("hash").agg(F.countDistinct("item").alias("often"))
    places = theirs.join(often, "hash").groupBy("item", "n", "place").agg(F.sum("often").alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "place"))
    chosen = places.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(coverage * F.col("n") - 1e-9) + 1)
    return theirs.join(chosen.select("item", "place"), ["item", "place"], "left_semi").select("hash", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, n_matched, n_windows, coverage, exact: a row for each document and item that it holds."""
    theirs = item_windows(items)
    rare = written(rare_windows(theirs, coverage), "rare")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(_emitter(["doc_id", "text_hash"], bit_table(theirs)), "doc_id long, text_hash long, place long, hash long, slots array<long>, loose boolean")
    # Readings of a place that hash alike have the same slots.
    own = own.groupBy("doc_id", "text_hash", "place", "hash").agg(F.first("slots").alias("slots"), F.min("loose").alias("loose"))
    own = written(own, "own")
    # Only pairs that share a rare window are looked at; a window that many items have makes no pairs of its own.
    asked = own.join(rare, "hash").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col("item").alias("__i")).distinct()
    pairs = own.join(asked, own["doc_id"].eqNullSafe(asked["__d"]) & (own["text_hash"] == asked["__t"]))
    named = theirs.withColumnsRenamed({"place": "item_place", "slots": "item_slots", "loose": "item_loose", "hash": "__h"})
    met = pairs.join(named, (F.col("hash") == F.col("__h")) & (F.col("__i") == F.col("item")))
    by = ["doc_id", "text_hash", "item", "item_id", "n"]
    met = written(met.select(*by, (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "item_slots", "slots", (F.col("loose") | F.col("item_loose")).alias("loose")), "met")
    filled = met.select(*by, "shift", "loose", F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*by, "shift", "loose", F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")).filter("a <> 0 and b <> 0")
    filled = filled.groupBy(*by, "shift", "a", "b").agg(F.min("loose").alias("loose"))

    def one_to_one(a: Column, b: Column) -> Column:
        return (F.count(a) == F.countDistinct(a)) & (F.count(b) == F.countDistinct(b))

    firm = [F.when(~F.col("loose"), F.col(c)) for c in ("a", "b")]
    pairs = filled.groupBy(*by, "shift").agg(
        one_to_one(F.col("a"), F.col("b")).alias("all_fit"), one_to_one(*firm).alias("firm_fit"),
        F.max((F.col("a") != F.col("b")).cast("int")).alias("moved"), F.coalesce(F.max((firm[0] != firm[1]).cast("int")), F.lit(0)).alias("firm_moved"),
    )
    renamed = pairs.select(*(F.col(c).alias(f"__{c}") for c in (*by, "shift")), "all_fit", "firm_fit", F.when(F.col("all_fit"), F.col("moved")).otherwise(F.col("firm_moved")).alias("moved"))
    same = None
    for c in (*by, "shift"):
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    judged = met.join(renamed, same, "left").filter("all_fit is null or all_fit or (firm_fit and not loose)")
    whole = judged.groupBy(*by).agg(F.countDistinct("item_place").alias("n_matched"), F.coalesce(F.max("moved"), F.lit(0)).alias("moved"))
    return whole.filter(F.col("n_matched") >= coverage * F.col("n")).select("doc_id", "text_hash", "item_id", "n_matched", F.col("n").alias("n_windows"), (F.col("n_matched") / F.col("n")).alias("coverage"), (F.col("moved") == 0).alias("exact"))


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, exact."""
    return contaminated(docs, items).drop("text_hash").distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item."""
    bad = written(contaminated(docs, items).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__t"]), "left_anti")
