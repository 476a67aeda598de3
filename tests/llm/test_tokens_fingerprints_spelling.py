"""Operators 11 to 13 against plain code: on small tables with nulls, empty and repeated rows, clashing columns, and on whole tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pliego.llm import alignment, fingerprints, queries, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
TEXTS = [
    (1, "The colour of the house\nand the color of the sky"), (2, None), (3, ""), (4, "a"), (5, " <|endoftext|> </s> naïve café 日本語 🙂\n\n\ttabs"),
    (6, "▁underscores▁ and \u0000 nul"), (7, "colour colour color colours colour favourite favorite favorite"), (7, "colour colour color colours colour favourite favorite favorite"),
    (9, "long " * 3000), (10, "abc"), (-4, "one\ntwo\nthree"), (12, "three\none\ntwo"), (None, "no id at all, colour"), (14, "x" * 70),
]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("a_ids", "groups", "n_best", "row", "fingerprint", "mark", "stretch", "word", "n", "key"):
        made = made.withColumn(name, F.lit("clash"))
    return made


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def plain_alignment(rows):
    """Each text by the two libraries themselves, bytes owned one at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    import public_tokenizers as P

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    own = {chr(c): c for c in printed} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(printed)))}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode()

    out, held = [], Counter()
    for i, text in rows:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        of_a, of_b = [bytes(own[c] for c in a.id_to_token(t)) for t in ids_a], [piece(t) for t in ids_b]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            out.append((i, [], [], [], ""))
            continue
        who_a, who_b = ([k for k, t in enumerate(of) for _ in t] for of in (of_a, of_b))
        links = sorted(set(zip(who_a, who_b, strict=True)))
        ends = sorted({at for at in range(1, len(who_a) + 1) if at == len(who_a) or (who_a[at] != who_a[at - 1] and who_b[at] != who_b[at - 1])})
        groups, start = [], 0
        for end in ends:
            parts = [dict.fromkeys(who[start:end]) for who in (who_a, who_b)]
            groups.append("|".join(",".join(str(ids[k]) for k in part) for ids, part in zip((ids_a, ids_b), parts, strict=True)))
            start = end
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        held.update(set(pairs))
        out.append((i, ids_a, ids_b, pairs, ";".join(groups)))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return [(i, len(x), len(y), s.count("|"), len(p), sum(held[q] == top[q[0]] for q in p), sum(held[q] for q in p), digest(s)) for i, x, y, p, s in out]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_the_libraries_on_a_whole_table(spark):
    got = queries.op11_alignment(spark, SF)
    assert set(got.columns) == set(ALIGNED)
    assert sorted(map(tuple, got.select(ALIGNED).collect())) == sorted(plain_alignment(texts_of(spark)))


@pytest.mark.parametrize("most", [alignment.SLICE, 40])
def test_alignment_of_odd_rows(spark, docs, most):
    first, first_file, second, second_file = queries.tokenizers()
    sizes = [np.array([len(t) for t in make(data).texts]) for make, data in ((first, first_file), (second, second_file))]
    aligned = alignment.align(docs, first, first_file, second, second_file)
    assert {"mark", "stretch", "row", "text"} <= set(aligned.columns)
    got = alignment.with_counts(alignment.stored(aligned.drop("n_best")), *sizes, most=most)
    found = sorted(((r.doc_id, len(r.a_ids) // 2, len(r.b_ids) // 2, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got.collect()), key=str)
    assert found == sorted(plain_alignment(TEXTS), key=str)


def test_alignment_in_small_spans(monkeypatch):
    sizes = [np.array([3, 1, 4, 2, 6, 1, 1]), np.array([2, 2, 4, 8, 1, 1])]
    whole = alignment.overlaps(*sizes)
    monkeypatch.setattr(alignment, "SPAN", 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, alignment.overlaps(*sizes), strict=True))


def test_alignment_of_nothing(spark, empty):
    first, first_file, second, second_file = queries.tokenizers()
    aligned = alignment.stored(alignment.align(empty, first, first_file, second, second_file))
    assert alignment.with_counts(aligned, np.ones(50257, int), np.ones(32000, int)).count() == 0


def plain_print(text):
    """The exact lanes as a set of paragraphs, the sketch by one stretch at a time."""
    return Counter((text or "").split("\n")), Counter(bytes(max(0, 16 - k)) + p[max(0, k - 16) : k] for p in (text or "").encode().split(b"\n") for k in range(1, len(p) + 1))


def check_edited(rows, got):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for place, k in enumerate(order):
        i, text, following = rows[k][0], rows[k][1] or "", rows[order[(place + 1) % len(order)]][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = by_id[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert base64.b64decode(r.fingerprint) == fingerprints.fingerprints([text.encode()])[0]
        assert base64.b64decode(r.edited_fingerprint) == fingerprints.fingerprints([edited.encode()])[0]
        assert (r.near_edited == 1) == (plain_print(text)[0] == plain_print(edited)[0])
        assert (r.near_next == 1) == (plain_print(text)[0] == plain_print(following)[0])
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = plain_print(text)[1], plain_print(other)[1]
            both = sum(n * n for n in a.values()) + sum(n * n for n in b.values())
            true = 1 - sum((a[g] - b[g]) ** 2 for g in a.keys() | b.keys()) / both if both else float(text == other)
            assert abs(near - max(true, 0)) < 0.5 and 0 <= near <= 1


def test_fingerprints_of_a_whole_table(spark):
    rows, got = texts_of(spark), queries.op12_fingerprints(spark, SF).collect()
    check_edited(rows, got)
    assert np.mean([r.near_edited for r in got]) > 0.6
    assert sum(r.near_edited > r.near_next for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize("stretches", [1, 3, 50])
def test_fingerprints_of_odd_rows(spark, docs, stretches):
    once = docs.where("doc_id is null or doc_id <> 7")
    check_edited([t for t in TEXTS if t[0] != 7], fingerprints.compare_edited(once, stretches).collect())
    # rows that share an id stay rows of their own
    assert fingerprints.compare_edited(docs, stretches).count() == len(TEXTS)


def test_fingerprints_of_one_row_and_of_nothing(spark, empty):
    assert fingerprints.compare_edited(empty).count() == 0
    (r,) = fingerprints.compare_edited(spark.createDataFrame([(5, "abcdefgh")], SCHEMA)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
    (r,) = fingerprints.compare_edited(spark.createDataFrame([(5, None)], SCHEMA)).collect()
    assert (r.n_chars, r.near_edited, r.near_next) == (0, 1, 1)


def test_fingerprints_add_and_take(spark, docs, monkeypatch):
    prints = lambda *t: fingerprints.fingerprints([x.encode() for x in t])
    ab, ba, a, b, aab = prints("first part\nsecond", "second\nfirst part", "first part", "second", "first part\nsecond\nfirst part")
    assert ab == ba == fingerprints.added(a, b) and aab != ab
    assert fingerprints.taken(aab, a) == ab and fingerprints.taken(ab, b) == a
    assert len(set(prints("", "\n", "a\n", "\na\n", "a"))) == 5
    monkeypatch.setattr(fingerprints, "SPAN", 7)
    assert prints("first part\nsecond", "", "second\nfirst part", "first part") == [ab, prints("")[0], ab, a]
    made = fingerprints.fingerprint(docs)
    assert set(made.columns) == set(docs.columns)
    assert {bytes(r.fingerprint) for r in made.where("doc_id in (-4, 12)").collect()} == {prints("one\ntwo\nthree")[0]}


def plain_words(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def plain_variants(n):
    """Every pair through the strings that deleting one code point leaves."""
    left = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            left[w[:k] + w[k + 1 :], k].add(w)
    shorter = defaultdict(set)
    for (rest, _), ws in left.items():
        shorter[rest] |= ws
    near = {w: set() for w in n}
    for ws in left.values():
        for w in ws:
            near[w] |= ws - {w}
    for rest, ws in shorter.items():
        if rest in n:
            near[rest] |= ws
            for w in ws:
                near[w].add(rest)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_of_a_whole_table(spark):
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, SF).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_words(texts_of(spark)))


def test_spelling_of_odd_rows(spark, docs, empty):
    got = {(r.word, r.n) for r in spelling.vocabulary(docs).collect()}
    assert got == set(plain_words(TEXTS).items()) and "colour" in {w for w, _ in got}
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


@pytest.mark.parametrize(("letters", "longest", "most"), [("ab", 9, 20_000), ("ab", 9, 3), ("aé", 7, 1), ("abc", 6, 10)])
def test_spelling_of_dense_words(spark, letters, longest, most):
    rng = random.Random(len(letters) + most)
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.choice([3, 5, 6, 9, 12, 40, 81, 200]) for _ in range(300)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(table, most=most).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(words)
