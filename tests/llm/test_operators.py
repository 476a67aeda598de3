"""Each operator on small tables with nulls, empty and repeated rows, clashing columns and empty inputs, against plain code."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pliego.llm import bpe, chat, common, counts, covertree, fmindex, lines, mixing, neardup, quality, substring, toxicity
from pliego.llm.queries import ranks

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BASE = " ".join(f"word{i}" for i in range(70))
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("word5 ", "other "), "en", None), (4, None, None, "b"), (5, "", "fr", "b"),
    (6, "one two", "en", "b"), (7, "One TWO", "en", None), (8, "x " + BASE + "\nanother line that has many words\nanother line that has many words", "en", "a"),
    (9, "Another line that has many words indeed\n" + "long " * 5000, "en", "c"), (9, "same id, other text", "fr", "c"), (9, "same id, other text", "fr", "c"), (10, " \n\t ", "fr", "c"),
    (11, "é" * 30 + " ünï <b>|%$# 12 日本語 the the the the the the the the the the", "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("n_words", "component_id", "kept", "key", "class", "row", "score", "n_lines", "token_ids", "gone", "size"):
        made = made.withColumn(name, F.lit("clash"))
    return made


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(WORD, text or "")


def test_bpe_equals_tiktoken(spark, docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    data, pattern = ranks()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    out = bpe.decode(bpe.encode(docs, data, pattern), data)
    assert set(docs.columns) | {"decoded"} == set(out.columns)
    for r in out.collect():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == plain.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    assert bpe.encode(empty, data, pattern).count() == 0


def test_workers_forget_texts_after_encoding(spark, docs):
    """Workers live on: after a task they hold their vocabulary, and no memo of its texts."""
    data, pattern = ranks()
    own = bpe.encode(docs.select("doc_id", "text").repartition(4), data, pattern)
    assert sum(len(r.token_ids) for r in own.collect())

    def held(batches):
        for batch in batches:
            found = [len(c.memo) + len(c.memo.before) + len(c.fits) for c in bpe._CODECS.values()]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([sum(found)], pa.int64())], names=["codecs", "entries"])

    rows = spark.range(0, 8, 1, 8).mapInArrow(held, "codecs long, entries long").collect()
    assert sum(r.codecs for r in rows) and not sum(r.entries for r in rows)


def test_counts_follow_edits(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    data, pattern = ranks()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    edits = spark.createDataFrame([(i, s, *e) for i in range(1, 12) for s, e in enumerate([(3, 4, "it's  new"), (-5, 0, "x"), (40, 100000, None), (9999999, None, " end ")])], "doc_id long, seq int, start int, length int, insert string")
    got = sorted((r.doc_id, r.n_before, r.n_tokens) for r in counts.count_tokens(counts.with_edits(docs, edits), data, pattern).collect())
    want = []
    for i, text, *_ in TEXTS:
        t = now = text or ""
        for s, n, x in [(3, 4, "it's  new"), (0, 0, "x"), (40, 100000, ""), (9999999, 0, " end ")]:
            now = now[: min(s, len(now))] + x + now[s + n :]
        want.append((i, len(plain.encode_ordinary(t)), len(plain.encode_ordinary(now))))
    assert got == sorted(want)


def linked(texts, percent, width=5):
    sets = []
    for _, text, *_ in texts:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(t[0] for t, x in zip(texts, group, strict=True) if x == g) for g in group}
    return sorted((t[0], len(s), least[g]) for t, s, g in zip(texts, sets, group, strict=True))


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 5, 85).collect())
    assert got == linked(TEXTS, 85)
    kept = neardup.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, c in linked(TEXTS, 80) if i == c})
    assert neardup.near_duplicates(empty).count() == 0


def test_siblings_come_from_whole_texts(spark, tmp_path):
    import __spark_entry__

    opening = "one opening of more than sixty characters that many texts have in common "
    rows = [(4, BASE, "en", "a"), (2, "put in front " + BASE, "en", "a"), (7, "other " + BASE, "en", "a"), (5, BASE, "en", "b"), (8, None, "en", "a"), (9, None, "en", "a"), (11, "", "en", "a")]
    rows += [(20 + i, opening + " ".join(f"w{i}x{j}" for j in range(40)), "en", "a") for i in range(3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["near_copy_inherit"](spark, str(tmp_path)).collect()
    seen, want = defaultdict(int), []
    for i, _, root in linked(rows, 85):
        want.append((i, root, seen[root]))
        seen[root] += 1
    assert sorted((r.doc_id, r.inherits_from, r.position_) for r in found) == want
    assert {root for i, root, _ in want if i < 8} == {2}


def test_positions_go_on_over_pieces(spark):
    rows = [(i, BASE if i % 3 else f"{BASE} {i}", "en", "a") for i in range(50)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # several pieces, small as the table is
    try:
        found = neardup.inherit(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset(key)
    assert sorted((r.doc_id, r.inherits_from, r.position_) for r in found) == [(i, 0, i) for i in range(50)]


@pytest.mark.parametrize("turned", [False, True])
def test_of_rows_with_one_id_the_clean_one_stays(spark, turned):
    rows = [(1, BASE, "en", "a")]
    for i in range(2, 12):
        two = [(i, BASE, "en", "a"), (i, " ".join(f"own{i}x{j}" for j in range(40)), "en", "a")]
        rows += two[::-1] if turned else two
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(1), 5, 80)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((i, t) for i, t, *_ in rows if i == 1 or t != BASE)


def test_blocks_of_a_large_list_lose_no_link(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(7 * i) % 13 if j == i % 40 else j}" for j in range(60)), "en", "a") for i in range(120)]
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 80).collect())
    assert got == linked(rows, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_links_pass_the_sketches(percent):
    """Pairs just similar enough whose sketches share few values (a chance of over 1e-9), also where all shared ones are crowded."""
    unshared = {80: 31, 85: 29}[percent]
    assert sum(math.comb(64, k) * (1 - percent / 100) ** k * (percent / 100) ** (64 - k) for k in range(unshared, 65)) > 1e-9
    small = np.arange(unshared, unshared * percent // (100 - percent) + unshared + 1, dtype=np.uint64)
    large = np.concatenate([np.arange(unshared, dtype=np.uint64), small])
    assert neardup.similar(small, large, percent) and neardup.links([small, large], None, percent) == [(0, 1)]
    level = np.zeros(2**neardup.TABLE_BITS, np.int8)
    level[neardup._buckets(small)] = 1
    level[neardup._buckets(large[:unshared])] = 0
    first, second = (neardup.listed(x[:64], len(x), level, percent) for x in (small, large))
    assert np.isin(first, second).any()


def test_components(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (2, 2), (None, 1)], "a long, b long")
    assert sorted(map(tuple, common.components(pairs).collect())) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


def removed(texts, width):
    first = defaultdict(lambda: 1 << 62)
    for i, text, *_ in texts:
        w = words(text)
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(first[tuple(w[k : k + width])], i)
    out = []
    for i, text, *_ in texts:
        w, gone = words(text), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 1_000_000])
def test_substring_dedup_equals_brute_force(spark, docs, empty, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD", shard)
    for width in (5, 50):
        assert sorted(map(tuple, substring.remove_repeats(docs, width).collect())) == removed(TEXTS, width)
    assert substring.remove_repeats(empty).count() == 0


def test_fm_index_matches_any_pattern():
    rng = np.random.default_rng(2)
    for _ in range(60):
        width, size = int(rng.integers(1, 7)), int(rng.integers(1, 5))
        rows = [rng.integers(0, size, int(rng.integers(1, 30))).astype(np.uint64) for _ in range(int(rng.integers(1, 9)))]
        owners = rng.integers(0, 30, len(rows))
        known = {}
        for s, o in zip(rows, owners, strict=True):
            for i in range(len(s) - width + 1):
                known[tuple(s[i : i + width])] = min(int(o), known.get(tuple(s[i : i + width]), 99))
        asked = [rng.integers(0, size + 1, int(rng.integers(1, 30))).astype(np.uint64) for _ in range(5)] + rows
        for s, found in zip(asked, fmindex.FMIndex(rows, owners, width).stream(asked), strict=True):
            assert found.tolist() == [known.get(tuple(s[i : i + width]), -1) for i in range(len(s) - width + 1)]


def test_line_dedup_equals_brute_force(spark, docs, empty):
    seen, want = [], []
    for i, text, *_ in sorted(TEXTS, key=lambda t: t[0]):
        for k, line in enumerate((text or "").split("\n")):
            seen.append((i, k, frozenset(words(line.translate(LOWER)))))
    for i, text, *_ in TEXTS:
        kept = []
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(words(line.translate(LOWER)))
            earlier = (x for a, b, x in seen if (a, b) < (i, k) and len(x) >= 5)
            if len(s) < 5 or not any(100 * len(s & x) >= 80 * len(s | x) for x in earlier):
                kept.append(line)
        want.append((i, None if text is None else "\n".join(kept)))
    out = lines.remove_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_removed"}
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert lines.remove_lines(empty).count() == 0


@pytest.mark.parametrize(("nearest", "longest"), [(1, 50_000), (16, 50_000), (2, 10)])
def test_line_dedup_needs_no_luck_with_candidates(spark, monkeypatch, nearest, longest):
    """Few candidates at a time, and lists that are dealt out as pairs of blocks."""
    monkeypatch.setattr(lines, "NEAREST", nearest)
    monkeypatch.setattr(lines, "GROWTH", 2)
    monkeypatch.setattr(lines, "LIST", longest)
    rows = [(i, " ".join(f"w{i}x" if j in (i % 7, (3 * i) % 11) else f"w{j}" for j in range(12)), "en", "a") for i in range(60)]
    sets = [frozenset(words(t)) for _, t, *_ in rows]
    want = {i for i in range(60) if any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))}
    got = {r.doc_id for r in lines.remove_lines(spark.createDataFrame(rows, SCHEMA)).where("n_removed = 1").collect()}
    assert got == want


def test_line_lists_of_later_rounds_are_whole(spark, monkeypatch):
    """Later rounds over many input partitions: no list is split between tasks, whatever Spark makes of the joins before."""
    monkeypatch.setattr(lines, "NEAREST", 1)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{j}" for j in sorted(rng.choice(30, 14, replace=False))) + " " + " ".join(f"v{j}" for j in range(14)), "en", "a") for i in range(300)]
    sets = [frozenset(words(t)) for _, t, *_ in rows]
    want = {i for i in range(300) if any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))}
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "4k")
        got = {r.doc_id for r in lines.remove_lines(spark.createDataFrame(rows, SCHEMA).repartition(8)).where("n_removed = 1").collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert 30 < len(want) < 300 and got == want


def test_line_entries_are_packed():
    """Entries travel as few bytes: those that are zero in a whole column are left out, and all come back."""
    rng = np.random.default_rng(6)
    columns = np.stack([rng.integers(0, 2**32, 500), rng.integers(-(2**63), 2**63 - 1, 500), np.arange(500), np.zeros(500, np.int64)])
    block = lines.packed(columns)
    assert (lines.unpacked(block, 4) == columns).all() and len(block) < 500 * 15
    assert lines.unpacked(lines.packed(columns * 0), 4).shape == (4, 500)


def test_short_lines_are_compared(spark, tmp_path):
    import corpus_pipeline
    from pliego.llm import queries

    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(" ".join(rng.choice(list("abcdef"), int(rng.integers(0, 7)))) for _ in range(4)), "en", "a") for i in range(40)]
    rows += [(40, "Les.\nq r s t", "en", "a"), (41, "q r s t u\nles.\nq r s\n", "en", "a"), (42, "LES.", "en", "a")]
    seen, want = [], {}
    for i, text, *_ in rows:
        kept = []
        for line in text.split("\n"):
            s = frozenset(words(line.translate(LOWER)))
            if not s or not any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                kept.append(line)
            seen.append(s)
        want[i] = "\n".join(kept)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(text.encode()).hexdigest() for i, text in want.items()}
    stage = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    before = {i: text for i, text, *_ in rows}
    assert stage == {i: text for i, text in want.items() if words(text) or text == before[i]}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] * (1 + i) + rng.normal(size=8) * 0.1 * (i % 3)).tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (7, rows[7][1])]
    good = [(k, np.array(v)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links, group = defaultdict(int), list(range(len(rows)))
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                links[a] += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    want = sorted((rows[k][0], links[k], least[group[k]]) for k in range(len(rows)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in covertree.near_vectors(frame, 0.9).collect()) == want
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 90), "en", f"s{i % 5}") for i in range(4000)] + TEXTS
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(frame).collect()
    assert sorted(got, key=str) == sorted(mixing.plan(frame).collect(), key=str)
    by = defaultdict(list)
    for r in got:
        assert r.copies <= 2
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * total)
    for rs in by.values():
        taken = sum(r.copies * r.size for r in rs)
        assert abs(taken - rs[0].target) <= max(r.size for r in rs)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.plan(docs).collect())
    assert mixing.plan(empty).count() == 0


def test_quality_base_rules(spark, docs, empty):
    for r in quality.apply(docs).collect():
        text = next(t for i, t, *_ in TEXTS if i == r.doc_id and len(words(t)) == r.n_words)
        w = words(text)
        seen, again = defaultdict(list), set()
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        for places in seen.values():
            if len(places) > 1:
                again.update(p + j for p in places for j in range(8))
        worded = [x for x in (text or "").split("\n") if words(x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.apply(empty).count() == 0


def test_quality_fences_follow_the_source(spark):
    """Each text is usual in one source and far out in the other, for each rate, and below any fixed cutoff."""
    plain = lambda i, n=24, size=4: [f"{i:03d}{j:02d}"[-size:].rjust(size, "x") for j in range(n)]
    symbols = lambda i: " ".join(plain(i) + ["#"] * 5)
    repeats = lambda i: "\n".join([" ".join(plain(i)[k : k + 3]) for k in range(0, 24, 3)] + ["ab cd"] * 4)
    longer = lambda i: " ".join(plain(i, size=8))
    for odd in (symbols, repeats, longer):
        rows = [(i, " ".join(plain(i)), "en", "usual") for i in range(300)] + [(300 + i, odd(i), "en", "odd") for i in range(300)]
        rows += [(600, odd(1), "en", "usual"), (601, odd(1), "en", "odd")]
        kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.apply(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert kept[600] == (False, False) and kept[601] == (False, True)
        assert all(kept[i] == (False, True) for i in range(600))


def test_toxicity_learns_misspellings(spark):
    rng = np.random.default_rng(0)
    plain = ["lorem", "ipsum", "dolor", "amet", "magna", "aliqua", "tempor", "labore"]
    rows = []
    for i in range(600):
        w = rng.choice(plain, int(rng.integers(5, 200))).tolist()
        if i % 5 == 0:
            w.insert(int(rng.integers(len(w))), str(rng.choice(["idiot", "idioot", "idiots", "moron", "morons"])))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    fresh = [(0, "lorem ipsum idiotic dolor amet", 1), (1, "lorem MORON magna " * 3, 1), (2, "lorem ipsum " * 3000, 0), (3, None, 0), (4, "", 0)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, toxic int"), model).collect()}
    assert [got[i].predicted for i in range(5)] == [t for *_, t in fresh]
    held = toxicity.score(frame, model).where("held_out").join(frame, "doc_id")
    assert held.where("predicted <> toxic").count() <= 0.02 * held.count()
    assert toxicity.reject(frame, model).columns == frame.columns
    assert got[3].score == got[4].score == 0 and got[2].score < 0.1
    unseen = toxicity.score(spark.createDataFrame([(1, "xyzzy plugh quux")], "doc_id long, text string"), model).first()
    assert unseen.predicted == 0


def test_toxicity_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 5, 6, 8, 9, 10, 11)] + [(4, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert sorted(r.doc_id for r in found) == sorted(t[0] for t in TEXTS)
    assert all(0 <= r.score <= 1 for r in found)
    # two labelled texts without a word that aren't held out decide what others like them score
    blank = [(5, 1), (10, 0)]
    known = [t for i, t in blank if not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0]]
    want = sum(known) / len(known) if known else 0.0
    assert {r.score for r in found if r.doc_id in (4, 5, 10)} == {want}
    assert toxicity.score(empty, model).count() == 0 and toxicity.reject(empty, model).count() == 0
    assert toxicity.reject(docs, model).columns == docs.columns
    nothing = toxicity.fit(empty, labels)
    assert {r.score for r in toxicity.score(spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string"), nothing).collect()} <= {0.0, 1 / (1 + math.exp(-nothing.bias))}
    one_class = toxicity.fit(docs, labels.where("toxic = 1"))
    assert all(r.predicted == 1 for r in toxicity.score(docs, one_class).collect())


def test_toxicity_sample_is_bounded_in_bytes(spark):
    rows = [(i, f"w{i} " * 100, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda sample: seen.append(sample) or (np.zeros(2**toxicity.TABLE_BITS, np.float32), 0.0)
        toxicity.fit(frame, frame.select("doc_id", "toxic"), most=4000)
        toxicity.fit(frame, frame.select("doc_id", "toxic"))
    finally:
        toxicity.train = train
    assert 0 < len(seen[0].toxic) <= 13 < len(seen[1].toxic)
    assert len(seen[0].word) == seen[0].firsts[-1] == 100 * len(seen[0].toxic)


def test_toxicity_gradients_do_not_hang_on_pieces():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "vile"], int(rng.integers(1, 30)))) for _ in range(50)]
    vocabulary = sorted({w for t in texts for w in t.split()})
    rows, per, _ = toxicity.features(__import__("pyarrow").array([" ".join(vocabulary)]))
    word = np.array([vocabulary.index(w) for t in texts for w in t.split()], np.int32)
    firsts = np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])])
    sample = toxicity.Sample(word, firsts, np.array(["vile" in t for t in texts], np.float32), rows, per)
    whole, bias = toxicity.train(sample, rounds=3)
    sample.pieces = lambda: toxicity.Sample.pieces(sample, 7)
    parts, other = toxicity.train(sample, rounds=3)
    assert np.allclose(whole, parts, atol=1e-4) and bias == pytest.approx(other, abs=1e-4)


def test_chat_folds_edits_and_reads_back(spark):
    text = r"\### Assistant: </turn> ok"
    events = [
        (1, 0, "message", 0, "user", text), (1, 1, "message", 1, "assistant", "He"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", 2, "user", "bad"), (1, 4, "edit", 0, None, "edited " + text),
        (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, None, "a\\"), (1, 7, "delta", 1, None, "<b>"), (2, 0, "delta", 0, "assistant", "only"), (2, None, "delta", 0, None, "first "), (3, 0, "message", None, None, None),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq int, kind string, turn int, role string, text string")
    back = chat.read_back(chat.render(chat.fold(log)))
    got = sorted(((r.conv_id, r.turn, r.role, r.text, r.loss_text) for r in back.collect()), key=str)
    assert got == sorted([(1, 0, "user", "edited " + text, ""), (1, 1, "assistant", "a\\<b>", "a\\<b>"), (2, 0, "assistant", "first only", "first only"), (3, None, "", "", "")], key=str)
    one = next(r for r in chat.digest(back).collect() if r.conv_id == 1)
    assert one.turns_sha256 == hashlib.sha256(f"user\nedited {text}\nassistant\na\\<b>\n".encode()).hexdigest()
    assert one.loss_sha256 == hashlib.sha256(b"a\\<b>").hexdigest()


def folded(events):
    """What `chat.fold` says, one event after another."""
    turns = {}
    first = lambda e: (e[1] or 0, e[2] == "delta", e[5] or "", e[2], -1 if e[3] is None else e[3])
    for _, _, kind, turn, role, text in sorted(events, key=first):
        key = -1 if turn is None else turn
        if kind == "regenerate":
            turns = {t: x for t, x in turns.items() if t <= key}
        if kind == "edit" and key not in turns:
            continue
        old = turns.get(key, ("", ""))
        turns[key] = (role if role is not None else old[0], (old[1] if kind == "delta" else "") + (text or ""))
    return turns


def test_chat_folds_random_logs(spark):
    rng = np.random.default_rng(8)
    kinds = ["message", "delta", "delta", "edit", "regenerate"]
    rows = []
    for conv in range(300):
        for seq in range(int(rng.integers(0, 14))):
            turn = int(rng.integers(-1, 4))
            rows.append((conv, int(rng.integers(0, 10)) if conv % 2 else seq, str(rng.choice(kinds)), None if turn < 0 else turn, [None, "user", "assistant"][int(rng.integers(3))], [None, "a", "bb", "\\<#"][int(rng.integers(4))]))
    # a later turn's edit doesn't bring it back, and new deltas of it stay
    rows += [(900, 1, "message", 0, "user", "q"), (900, 2, "message", 1, "assistant", "x"), (900, 3, "message", 2, "user", "y"), (900, 4, "regenerate", 1, None, "z"), (900, 5, "edit", 2, None, "late")]
    rows += [(901, 1, "delta", 1, "assistant", "old"), (901, 2, "regenerate", 0, "user", "q"), (901, 3, "delta", 1, None, "new")]
    log = spark.createDataFrame(rows, "conv_id long, seq int, kind string, turn int, role string, text string")
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    # events that tie in all but their role have no order
    clear = {c for c, es in by.items() if len({(e[1], e[2], e[3], e[5] or "") for e in es}) == len(es)}
    want = sorted((c, t, *x) for c in clear for t, x in folded(by[c]).items())
    got = sorted((r.conv_id, -1 if r.turn is None else r.turn, r.role, r.text) for r in chat.fold(log).collect() if r.conv_id in clear)
    assert len(clear) > 200 and got == want
    assert [(r.turn, r.text) for r in sorted(chat.fold(log).where("conv_id = 900").collect(), key=lambda r: r.turn)] == [(0, "q"), (1, "z")]
    assert [(r.turn, r.text) for r in sorted(chat.fold(log).where("conv_id = 901").collect(), key=lambda r: r.turn)] == [(0, "q"), (1, "new")]


def test_chat_of_odd_logs(spark):
    schema = "conv_id long, seq int, kind string, turn int, role string, text string"
    assert chat.digest(chat.read_back(chat.render(chat.fold(spark.createDataFrame([], schema))))).count() == 0
    long = spark.createDataFrame([(1, 0, "message", i, "user" if i % 2 else "assistant", "t" * (i % 7)) for i in range(3000)] * 2, schema)
    clash = long.withColumn("log", F.lit(1)).withColumn("cut", F.lit(2)).withColumn("last", F.lit(3))
    one = chat.digest(chat.read_back(chat.render(chat.fold(clash)))).first()
    assert (one.n_turns, one.loss_chars) == (3000, sum(i % 7 for i in range(0, 3000, 2)))
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 0, "poke", 0, None, None)], schema)).collect()


@pytest.mark.parametrize("pattern", [None, r"[^\r\n\p{L}\p{N}]?\p{L}+(?:'s|'re)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"])
def test_counts_of_random_edits(pattern):
    data, shipped = ranks()
    codec = bpe.Codec(bpe.parse_ranks(data), pattern or shipped)
    known = counts.Counts(codec)
    rng = np.random.default_rng(5)
    signs = list("ab 1\n' .é") + ["\n\n", "   ", "'re", "x's"]
    for _ in range(300):
        text = "".join(rng.choice(signs, int(rng.integers(0, 900 if rng.random() < 0.1 else 60))))
        tree = counts.TokenTree(text, known)
        for _ in range(6):
            start, length, insert = int(rng.integers(0, len(text) + 2)), int(rng.integers(0, 6)), "".join(rng.choice(signs, int(rng.integers(0, 4))))
            tree.edit(start, length, insert)
            start = min(start, len(text))
            text = text[:start] + insert + text[start + length :]
            assert [p for leaf in tree.leaves for p in leaf] == codec.split(text)


def test_counts_behind_a_run_of_blanks():
    data, _ = ranks()
    codec = bpe.Codec(bpe.parse_ranks(data), r"\p{L}+|\s*[\r\n]+|\s+|.")
    tree = counts.TokenTree("a \n\n   b" + " " * 600 + "c", counts.Counts(codec))
    tree.edit(7, 0, "\n")
    assert [p for leaf in tree.leaves for p in leaf] == codec.split("a \n\n   \nb" + " " * 600 + "c")
    tree.edit(609, 0, "\n")
    assert [p for leaf in tree.leaves for p in leaf] == codec.split("a \n\n   \nb" + " " * 600 + "\nc")


def test_cover_trees_prune():
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 32))
    points = np.repeat(centers, 20, 0) + rng.normal(size=(600, 32)) * 0.02
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = covertree.Tree(points)
    assert len(tree.nodes) > 2 and len(tree.nodes[-1]) == 1
    for level in range(1, len(tree.nodes)):
        assert set(tree.nodes[level]) <= set(tree.nodes[level - 1])
    weight = np.ones(600, np.int64)
    linked = points @ points.T >= 0.9
    found, _, forest, visited = covertree.traverse(tree, tree, 0.9, True, weight, weight)
    assert found.tolist() == (linked.sum(1) - 1).tolist() and visited < 600 * 599 / 2 / 5
    one, two = covertree.Tree(points[:250]), covertree.Tree(points[250:])
    a, b, _, visited = covertree.traverse(one, two, 0.9, False, weight[:250], weight[250:])
    assert a.tolist() == linked[:250, 250:].sum(1).tolist() and b.tolist() == linked[:250, 250:].sum(0).tolist() and visited < 250 * 350 / 5
    # without any structure all hang on the root, and the results are the same
    flat = rng.normal(size=(300, 64))
    flat /= np.linalg.norm(flat, axis=1)[:, None]
    tree = covertree.Tree(flat)
    assert covertree.traverse(tree, tree, 0.9, True, np.ones(300, np.int64), np.ones(300, np.int64))[0].tolist() == ((flat @ flat.T >= 0.9).sum(1) - 1).tolist()


def test_pivots_of_each_dimension(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(400)] + [(400, [1.0, 2.0])]
    classes = covertree.classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = covertree.pivots(classes, 10)
    assert found[64].shape == (9, 64) and found[2].shape == (1, 2)


@pytest.mark.parametrize("cells", [8, 40])
def test_vectors_in_several_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(covertree, "BLOCK", cells)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 16))
    vectors = base[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * 0.2
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash")).withColumn("key", F.lit("clash"))
    assert {r.vec_id: r.n_links for r in covertree.near_vectors(frame, 0.9).collect()} == {i: int(linked[i].sum() - 1) for i in range(300)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_in_cones(spark, monkeypatch, kind):
    """Many vectors of many dimensions: links just over the threshold, dense groups and copies, over several rounds and parts."""
    for name, value in (("BLOCK", 200), ("CONE", 20), ("TASK", 300), ("ROUND", 0)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    flat = unit(rng.normal(size=(500, 32)))
    across = rng.normal(size=(200, 32))
    across = unit(across - (across * flat[:200]).sum(1)[:, None] * flat[:200])
    edge = 0.902 * flat[:200] + np.sqrt(1 - 0.902**2) * across  # partners just over the threshold
    dense = unit(flat[300] + rng.normal(size=(150, 32)) * 0.03)
    vectors = np.concatenate([flat, edge, dense, flat[:20]]).astype(np.float32 if kind == "float" else np.float64)
    x = unit(vectors.astype(np.float64))
    linked = x @ x.T >= 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(frame, 0.9).collect()}
    group = np.arange(len(x))
    while (least := np.where(linked, group[None], len(x)).min(1)).tolist() != group.tolist():
        group = least
    assert got == {i: (int(linked[i].sum() - 1), int(group[i])) for i in range(len(x))}


def test_cones_leave_out_most_pairs():
    """Vectors without structure, where trees alone look at all pairs: the cones of all tables hold fewer, and more so the more vectors there are."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(40_000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    shares = []
    for count in (10_000, 40_000):
        tables = covertree.axes_of(count, 64, 0.9)
        sizes = [np.unique(covertree.cones(covertree.rounded(points[:count]), t), return_counts=True)[1] for t in tables[:3]]
        shares.append(len(tables) * np.mean([(s * (s - 1) / 2).sum() for s in sizes]) / (count * (count - 1) / 2))
    assert shares[1] < shares[0] / 2 and shares[1] < 0.8


def test_bpe_memo_keeps_frequent_pieces(monkeypatch):
    """A pre-token that comes again and again is encoded once, however many others pass; decoding leaves the encoder's tables."""
    monkeypatch.setattr(bpe, "MEMO", 50)
    data, pattern = ranks()
    own = bpe.codec(data, pattern)
    own.memo = type(own.memo)(own)
    seen, encode_piece = [], own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda piece: seen.append(piece) or encode_piece(piece))
    texts = [f"again x{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(600)]
    packed = [own.encode(t) for t in texts]
    assert seen.count(b"again") == 1 and len(own.memo) <= 51
    held = bpe.token_texts(data)
    assert [bpe.decode_ids(p, held).decode() for p in packed] == texts and bpe.codec(data, pattern) is own


def test_parities_of_all_sizes():
    """Parities differ in fewer places than their sets, and lines up to MIDDLE words have 64 bits only."""
    sizes = (3, lines.MIDDLE, lines.MIDDLE + 1, lines.LONG + 1)
    made = lines.Lines(pa.array([" ".join(f"w{k}" for k in range(n)) + (" more" if again else "") for n in sizes for again in (0, 1)]), 1, np.zeros(2**lines.BUCKET_BITS, np.uint8))
    assert made.size.tolist() == [n + k for n in sizes for k in (0, 1)]
    apart = [int(np.bitwise_count(made.parity[0][k] ^ made.parity[0][k + 1])) for k in range(0, 8, 2)]
    assert apart == [1, 1, 1, 1]
    assert [bool(x) for x in made.parity[1][:3]] == [False] * 3 and made.parity[1][3:].all() and not made.parity[2][:6].any() and made.parity[2][6:].all()


def test_mix_salts_many_sources(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 5}") for i in range(500)] + TEXTS
    frame = spark.createDataFrame(rows, SCHEMA)
    usual = sorted(mixing.plan(frame).collect(), key=str)
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(mixing.plan(frame).collect(), key=str) == usual
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [50, 70, 95])
def test_links_of_other_similarities(spark, percent):
    rng = np.random.default_rng(percent)
    rows = []
    for i in range(60):
        words_ = [f"w{i // 2}x{j}" for j in range(80)]
        if i % 2:
            for j in rng.choice(80, int(rng.integers(0, 8)), replace=False):
                words_[j] = f"o{i}x{j}"
        rows.append((i, " ".join(words_), "en", "a"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, percent).collect())
    assert got == linked(rows, percent)
    assert len({c for _, _, c in got}) < 60


def test_quality_groups_lean_on_their_parents(spark):
    rng = np.random.default_rng(11)
    text = lambda k: " ".join(["word"] * 0 + [f"{rng.integers(1000, 9999)}" for _ in range(30)] + ["#"] * k)
    rows = [(i, text(0), "en", "big") for i in range(400)] + [(400 + i, text(3), "en", "small") for i in range(4)] + [(410, text(3), None, None), (411, text(0), "fr", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = quality.sketches(quality.measure(docs))
    limits = {(r.lang, r.source): r.fence for r in quality.fences(whole).collect()}
    assert set(limits) == {("en", "big"), ("en", "small"), (None, None), ("fr", None)}
    high = lambda k: limits[k]["symbols_per_word"].high
    assert high(("en", "big")) <= high(("en", "small"))
    # sketches merge in any order
    parts = quality.sketches(quality.measure(docs.where("doc_id % 3 = 1"))).unionByName(quality.sketches(quality.measure(docs.where("doc_id % 3 <> 1"))))
    again = {(r.lang, r.source): r.fence for r in quality.fences(parts).collect()}
    assert again == limits
    # tails of a large group are within the sketch's error of the exact ones
    measured = quality.measure(docs.where("source = 'big'"))
    sketch = quality.sketches(measured).groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    got = next(r for r in quality.quantiles(sketch, ["lang", "source"]).collect() if r.rate == "chars_per_word")
    exact = sorted(r.word_chars / r.n_words for r in measured.collect())
    assert got.mid == pytest.approx(exact[199], rel=0.011) and got.over == pytest.approx(exact[359], rel=0.011) and got.under == pytest.approx(exact[39], rel=0.011)
    assert quality.apply(docs).count() == len(rows)


BASE_SQL = r"""with d as (select doc_id, coalesce(text, '') t from documents), w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] l from d)
select doc_id, len(w) n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines from w"""


def test_registered_queries_agree_with_sql(spark):
    """Every registered operator on the smallest tables, against its SQL where it has one."""
    duckdb = pytest.importorskip("duckdb")
    from pliego.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings", "labels"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    made = {}
    for name, query in queries.QUERIES.items():
        if name.startswith("op"):
            out = query(spark, sf_dir)
            made[name] = [r.asDict() for r in out.collect()]
            assert made[name], name
        if name in queries.ORACLE_SQL:
            rel = con.sql(queries.ORACLE_SQL[name])
            want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
            key = lambda r: sorted((k, repr(round(v, 6) if isinstance(v, float) else v)) for k, v in r.items())
            assert sorted(map(key, made[name])) == sorted(map(key, want)), name
    base = con.sql(BASE_SQL)
    want = sorted(base.fetchall())
    assert sorted(tuple(r[c] for c in base.columns) for r in made["op10_quality_rules"]) == want


def test_pipeline_stages_on_odd_rows(spark, docs, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 0) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars")), empty.withColumn("n_chars", F.lit(1))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            found = out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == rows.columns, name
                rows = spark.createDataFrame(found, out.schema)
            else:
                assert all(r.decodes for r in found)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.where("not decodes").count() == 0
