"""Spelling variants: words of a corpus at distance one, by a trie self-join with active-node sets.

Two words at distance one (one code point inserted, deleted or replaced) agree outside the place of the
edit. The vocabulary is dealt by what they agree on: for each length L, words of L and L + 1 code points
are dealt by their first half and, again, by their last half of L, so the edit lies in the half that
isn't the key. A group that holds over `MOST` words is dealt anew by longer keys, its half halved, down
to a single code point, where the letters themselves bound a group. In each group a trie of the rest is
walked once; each node carries its active nodes, the trie's nodes at distance one at most, and each
end of a word reads off the words at distance one among them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut

#: Words of one group. At least the 90 + 90 * 90 rests that a group of single code points can have.
MOST = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, divisor: int = 97, chars: int = 5, times: int = 3) -> DataFrame:
    """(word, n): the words of `chars` code points and `times` occurrences at least.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased. A run whose hash with its
    doc_id is divisible by `divisor` loses one code point. Occurrences are summed within tasks before
    they are shuffled, so a frequent word costs one row for each task. Null texts have no words; a null
    doc_id is hashed as an empty string.
    """
    lowered = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(r"([a-zÀ-ÿ]+)"))).alias("run"))
    # a run that is too short stays so
    hashed = runs.where(F.length("run") >= chars).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    made = hashed.select(F.when(F.col("h") % divisor == 0, cut_short).otherwise(F.col("run")).alias("word"))
    return made.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= chars) & (F.col("n") >= times))


def _keyed(rows: DataFrame) -> DataFrame:
    """Add the key of rows (word, n, size, low, high): what stands outside low .. high, in places of the shorter length."""
    end = F.col("size") - F.col("high")
    size = F.length("word")
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    behind = F.substring(F.col("word"), size - end + 1, end)
    rest = F.substring(F.col("word"), F.col("low") + 1, size - end - F.col("low"))
    return rows.withColumn("key", F.concat_ws("|", "size", "low", "high", before, behind)).withColumn("rest", rest)


def _regions(*pairs: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*[F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in pairs]))


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, size, low, high, key, rest): rows of one key hold `most` words at most, or rests of one code point."""
    size = F.length("word")
    sizes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).where("size > 0")
    half = F.floor(F.col("size") / 2)
    rows = sizes.select("word", "n", "size", _regions((F.lit(0), half), (half, F.col("size"))).alias("r")).select("word", "n", "size", "r.low", "r.high")
    done = None
    while True:
        rows = _keyed(rows)
        hot = cut(rows.where("high - low > 1").groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > most).select("key"))
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cold = rows.join(hot, "key", "left_anti").select("word", "n", "size", "low", "high", "key", "rest")
        done = cold if done is None else done.unionByName(cold)
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        split = rows.join(hot, "key", "left_semi").select("word", "n", "size", _regions((F.col("low"), middle), (middle, F.col("high"))).alias("r"))
        rows = cut(split.select("word", "n", "size", "r.low", "r.high"))


class Node:
    __slots__ = ("below", "word")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.word: int | None = None


def trie(rests: list[str]) -> Node:
    root = Node()
    for i, rest in enumerate(rests):
        node = root
        for c in rest:
            found = node.below.get(c)
            if found is None:
                found = node.below[c] = Node()
            node = found
        node.word = i
    return root


def near_pairs(rests: list[str]) -> Iterator[tuple[int, int]]:
    """All ordered pairs of different places in `rests` (distinct strings) at distance one.

    Walks the trie once; a node's active nodes come from its parent's. `same` is the node's own
    string, so distance zero is the node itself; `near` maps the others by identity.
    """
    root = trie(rests)
    stack = [(root, {id(v): v for v in root.below.values()})]
    while stack:
        node, near = stack.pop()
        if node.word is not None:
            for v in near.values():
                if v.word is not None:
                    yield node.word, v.word
        for c, child in node.below.items():
            active = {id(node): node}  # c deleted
            for v in node.below.values():  # c replaced
                active[id(v)] = v
            for v in child.below.values():  # a code point inserted behind c
                active[id(v)] = v
            for v in near.values():  # the edit is made, the rest must match
                w = v.below.get(c)
                if w is not None:
                    active[id(w)] = w
            active.pop(id(child), None)
            stack.append((child, active))


def _common(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def _within(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """Of one group's rows (word, n, size, high, rest): each word with a near one, their number, and the most frequent's n and text.

    A pair can meet in two regions when its edit is at their border: the later one counts it. Pairs of
    two words of size + 1 count in the groups of their own length.
    """
    found: dict[int, list] = {}
    for i, j in near_pairs([r[4] for r in rows]):
        a, b = rows[i], rows[j]
        size, high = a[2], a[3]
        if len(a[0]) > size and len(b[0]) > size:
            continue
        # the shorter region is that of a word of `size`
        shortest = min(len(a[4]), len(b[4]))
        if high < size and len(a[4]) != len(b[4]) and _common(a[4], b[4]) >= shortest:
            continue
        best = found.setdefault(i, [0, 0, ""])
        best[0] += 1
        if b[1] > best[1] or (b[1] == best[1] and b[0] < best[2]):
            best[1:] = b[1], b[0]
    for i, (count, n, word) in found.items():
        yield rows[i][0], count, n, word


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, near_n, near): how many words are near each word, and the most frequent of them (ties: the smallest)."""
    dealt = groups(words, most).select("key", "word", "n", "size", "high", "rest")
    names = ["word", "n_near", "near_n", "near"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("key", "word", "n", "size", "high", "rest")], strict=True))
        out = []
        for _, group in groupby(rows, lambda r: r[0]):
            held = [r[1:] for r in group]
            if len(held) > 1:
                out.extend(_within(held))
            if len(out) > 10_000:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(work, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): follow forms to the last. Paths double each round; a form is ever more frequent, so none is a circle."""
    now = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        next_ = cut(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = next_.select("word", "root")
        if next_.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of a vocabulary (word, n) of distinct words.

    A word's form is the most frequent of its near words (ties: the smallest in code points) if it is `times`
    as frequent at least, else null; its root is where forms lead, the word itself if it has none.
    An empty vocabulary gives no rows.
    """
    held = cut(words.select("word", "n"))
    joined = held.join(near_words(held, most), "word", "left")
    has = F.col("near_n") >= times * F.col("n")
    made = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    return made.join(roots(made), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
