"""Operators of the llm folder against brute force, with the cases that their docstrings define."""

import array
import gzip
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanweave.llm import chat, decontamination, exact_dedup, licences, ngram_join, packing, quality, token_counts, toxicity, warc

WHITE = re.compile(r"[\x20\x09-\x0D]+")
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdeéñß") for _ in range(RNG.randint(1, 9))) for _ in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: Nulls, empty and white texts, a long one, equal ones, a repeated row, marks and other scripts.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "日本 語😀 İz"), (6, "x" * 3000), (7, text(9000)), (8, "a  b\nc"), (9, "a b c"), (9, "a b c"), (10, "a\x0bb\x0cc"), (None, "null id text here now"), (11, "it's <|endoftext|> don't")]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # Further columns whose names operators might use themselves.
    return df.select("doc_id", F.lit(1).alias("id"), "text", F.lit("x").alias("n"), F.lit(0).alias("keep_id")) if extra else df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts(spark):
    scores = token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    floor = min(scores.values()) - 10

    def count(word):
        best, used = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(end):
                s = scores.get(word[start:end])
                if s is not None and best[start] + s > top:
                    top, n = best[start] + s, used[start] + 1
            size = len(word[end - 1].encode())
            if word[end - 1] not in scores and best[end - 1] + size * floor > top:
                top, n = best[end - 1] + size * floor, used[end - 1] + size
            best.append(top)
            used.append(n)
        return used[-1]

    cases = [r for r in ODD if r[0] != 6] + [(20, "y" * 250)]
    expected = [(i, len(w := [x for x in WHITE.split(t or "") if x]), sum(count("▁" + x) for x in w)) for i, t in cases]
    assert rows(token_counts.token_counts(docs(spark, cases), scores), "doc_id", "n_pretokens", "n_tokens") == sorted(expected, key=repr)
    assert token_counts.token_counts(docs(spark, []), scores).count() == 0


def test_trie_does_not_depend_on_its_bound(monkeypatch):
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -2.5, "ba": -3.5}
    words = ["".join(RNG.choice("abc") for _ in range(RNG.randint(1, 12))) for _ in range(300)]
    whole = token_counts.Trie(scores)
    counts = [whole.insert("▁" + w) for w in words]
    monkeypatch.setattr(token_counts, "MAX_NODES", 20)
    small = token_counts.Trie(scores)
    assert [small.insert("▁" + w) for w in words] == counts


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def test_licences(spark):
    mit, gpl = licences.TEMPLATES["mit"], licences.TEMPLATES["gpl-2.0-notice"]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    cases = [*ODD, (30, mit), (31, f"{text(30)}\n\n{wrapped}\n\n{text(10)}"), (32, f"{text(8)}\nReleased under the MIT License.\n{text(5)}"), (33, gpl.upper().replace(" ", "%%% ")), (34, "Licensed under the CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (35, "license this and the software")]
    expected = []
    for i, t in cases:
        t = re.sub(r"[^\w\n]+|_", " ", (t or "").lower())
        for kind, units in (("line", t.split("\n")), ("block", [u for u in re.split(r"\n *\n", t)])):
            for k, u in enumerate(units):
                if kind == "block" and "\n" not in u:
                    continue
                w = u.split()
                g = set(zip(w, w[1:], strict=False))
                best = max(((math.floor(1000 * dice(g, h) + 1e-9), name) for name, x in licences.TEMPLATES.items() if dice(g, h := {tuple(b.split()) for b in licences.bigrams(x)}) >= 0.8), key=lambda p: (p[0], [-ord(c) for c in p[1]]), default=None)
                if best:
                    expected.append((i, kind, k, best[1], best[0]))
    assert rows(licences.matches(docs(spark, cases)), "doc_id", "unit_kind", "unit", "template", "dice") == sorted(expected, key=repr)
    assert {e[0] for e in expected} >= {30, 31, 32, 33, 34}
    assert licences.matches(docs(spark, [])).count() == 0


def test_licences_in_their_usual_layout(spark):
    """Licences with blank lines between paragraphs: alone, in other text, as a comment, without a blank line around."""
    heads = {"mit": ["The above copyright notice and", 'THE SOFTWARE IS PROVIDED "AS IS"'], "isc": ['THE SOFTWARE IS PROVIDED "AS IS"'], "apache-2.0-header": ["http://www", "Unless required", "See the License"], "gpl-3.0-header": ["This program is distributed", "You should have"], "bsd-2-clause": ["1. Redis", "2. Redis", "THIS SOFTWARE IS PROVIDED"], "unlicense": ["Anyone is", "In jurisdictions", 'THE SOFTWARE IS PROVIDED "AS IS"', "For more"]}
    cases, expected = [], set()
    for k, (name, starts) in enumerate(heads.items()):
        laid = licences.TEMPLATES[name]
        for start in starts:
            assert laid.count(f" {start}") == 1
            laid = laid.replace(f" {start}", f"\n\n{start}")
        laid = "\n".join("\n".join(textwrap.wrap(line, 72)) for line in laid.split("\n"))
        comment = "\n".join(f" * {line}".rstrip() for line in laid.split("\n"))
        head = f"{text(40)}\n{text(30)}\n\n"
        cases += [(10 * k, laid), (10 * k + 1, f"{head}{laid}\n\n{text(90)}"), (10 * k + 2, f"/*\n{comment}\n */\n{text(400)}"), (10 * k + 3, f"{laid}\n\n{text(200)}\n\n{laid}")]
        again = len(laid.split("\n")) + 3
        expected |= {(10 * k, name, 0, 1000), (10 * k + 1, name, 3, 1000), (10 * k + 2, name, 1, 1000), (10 * k + 3, name, 0, 1000), (10 * k + 3, name, again, 1000)}
    cases += [(90, "Released under\n\nthe MIT License."), (91, "Released under the\n\n" + text(50) + "\n\nMIT License."), (92, f"{text(60)}\n\nReleased under the MIT License.\n\n{text(60)}")]
    expected.add((90, "mit-notice", 0, 1000))
    found = licences.matches(docs(spark, cases)).collect()
    # The second paragraph of isc is enough alone, so its block is the row.
    assert {(r.doc_id, r.template, r.unit, r.dice) for r in found if r.unit_kind == "span"} == {x for x in expected if x[1] != "isc"}
    assert {(r.doc_id, r.template) for r in found if r.template in heads} >= {x[:2] for x in expected if x[1] in heads}


@pytest.mark.parametrize("limit", [packing.Capacity(tokens=64), packing.Capacity(tokens=64, documents=3, attention=1500), packing.Capacity(tokens=64, documents=5, rule="dot")])
def test_packing(spark, limit):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    cases = [r for r in ODD if r[0] not in (6, 7)] + [(100 + i, text(RNG.randint(0, 60))) for i in range(120)]
    cut = min(64, math.isqrt(limit.attention))  # a longer piece would cost more than a sequence may
    got = packing.pack(docs(spark, cases), path, limit).collect()
    by_doc = {}
    for i, t in cases:
        by_doc.setdefault(i, []).append(whole.encode(t or "", add_special_tokens=False).ids + [1])
    bins = {}
    for r in got:
        ids = by_doc[r.doc_id][0]
        assert r.start == r.piece * cut and r.length == min(cut, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(array.array("I", ids[r.start : r.start + r.length]).tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == sum(-(-len(x) // cut) for v in by_doc.values() for x in v)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64 and len(places) <= limit.documents and sum(n * n for _, n in places) <= limit.attention
    if limit.documents > 5:
        assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 2
    assert packing.pack(docs(spark, []), path, limit).count() == 0


def test_equal_rows_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs(spark, [(None, "a b c")] * 200 + [(1, "x y")] * 100), path, packing.Capacity(tokens=64))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    groups = [r["n"] for r in got.groupBy(F.floor(F.col("sequence_id") / (1 << 32)).alias("g")).agg(F.count("*").alias("n")).collect()]
    assert sum(groups) == 300 and len(groups) > 5 and max(groups) < 100
    assert got.where("doc_id is null").count() == 200


def test_word_ids_equal_the_tokenizer():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    pool = [*"abXYZ .,!?'sS\t\n\r\x0b\x1c\x85\xa0éÉñßİΣςσ09²ⅷ中😀́​　%$&*#|<>ﬁǅ", "<|endoftext|>", "'ll", "don't", " I'M ", "ŸŽ"]
    for _ in range(3000):
        x = "".join(RNG.choice(pool) for _ in range(RNG.randint(0, 14)))
        assert words.of_text(x) == array.array("I", words.tokenizer.encode(x, add_special_tokens=False).ids).tobytes(), repr(x)


def test_exact_dedup(spark):
    long = text(5000)
    cases = [*ODD, (40, long), (12, long.replace(" ", "  \t")), (41, long + "."), (42, long[:-1]), (13, long)]
    groups = {}
    norm = lambda t: WHITE.sub(" ", t or "")
    for i, t in cases:
        groups.setdefault(norm(t), []).append(i)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    expected = [(i, low(groups[norm(t)]), len(groups[norm(t)]), i == low(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in cases]
    got = rows(exact_dedup.exact_groups(docs(spark, cases)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(expected, key=repr)
    stay = exact_dedup.deduplicate(docs(spark, cases))
    assert stay.columns == docs(spark, cases).columns
    assert sorted(norm(r.text) for r in stay.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("cases", "stays"),
    [
        ([(1, "A"), (None, "A"), (None, "B")], [(1, "A"), (None, "B")]),
        ([(None, "A"), (None, "A"), (None, "B")], [(None, "A"), (None, "B")]),
        ([(3, "A"), (7, "A"), (7, "B")], [(3, "A"), (7, "B")]),
        ([(3, "A"), (3, "A"), (3, "B"), (7, "A"), (7, None), (8, "C")], [(3, "A"), (3, "B"), (7, None), (8, "C")]),
    ],
)
def test_an_id_with_several_texts_loses_none(spark, cases, stays):
    assert rows(exact_dedup.deduplicate(docs(spark, cases)), "doc_id", "text") == sorted(stays, key=repr)


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    class Same:
        def digest(self):
            return b"\0" * 8

    monkeypatch.setattr(exact_dedup.xxhash, "xxh64", lambda chunk: Same())
    df = docs(spark, [(1, "one"), (2, "two"), (3, "one")])
    made = exact_dedup.recipes(df)
    assert made.count() == 3
    collided = made.withColumn("prints", F.lit(b"\0" * 8))
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a: collided)
    assert rows(exact_dedup.exact_groups(df), "doc_id", "keep_id") == [(1, 1), (2, 2), (3, 1)]


def test_recipes_decide_and_sha256_only_checks(spark, monkeypatch):
    df = docs(spark, [(1, "one"), (2, "two"), (3, "one")])
    made = exact_dedup.recipes(df)
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a: made.withColumn("text_sha256", F.lit("same")))
    assert rows(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size") == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a: made.withColumn("text_sha256", F.col("id").cast("string")))
    with pytest.raises(Exception, match="one recipe has two texts"):
        exact_dedup.exact_groups(df).collect()


def test_columns_with_clashing_names(spark):
    df = docs(spark, [(1, "a b"), (1, "a  b"), (2, "a b"), (2, "c")]).withColumns({c: F.lit(5) for c in ("row", "sha", "copy", "__sha", "__score", "__text", "own", "best")})
    assert rows(exact_dedup.deduplicate(df), "doc_id", "text", "sha", "__sha") in ([(1, "a  b", 5, 5), (2, "c", 5, 5)], [(1, "a b", 5, 5), (2, "c", 5, 5)])
    assert exact_dedup.deduplicate(df).columns == ngram_join.keep_one(df).columns == df.columns
    scored = quality.score(df, quality.train([]), keep=True, out="score_")
    assert scored.columns[:-1] == df.columns and scored.count() == 4


def test_chunks_follow_content():
    data = bytes(RNG.randrange(256) for _ in range(60000))
    cut = exact_dedup.cut_points(data)
    assert cut[-1] == len(data) and all(exact_dedup.MIN_CHUNK <= b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *cut], cut[:-1], strict=False))
    moved = exact_dedup.cut_points(b"some more in front" + data)
    chunks = lambda d, c: {d[a:b] for a, b in zip([0, *c], c, strict=False)}
    assert len(chunks(data, cut) & chunks(b"some more in front" + data, moved)) > len(cut) // 2


def near_copy(t, rng, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split(" "))


def brute_components(cases):
    sets = {}
    for i, t in cases:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in WHITE.split(low) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_cases():
    rng = random.Random(8)
    cases = [r for r in ODD if r[0] is not None]
    passage = text(40, rng)
    for k in range(12):
        base = text(rng.choice([4, 6, 12, 60, 200]), rng)
        cases += [(1000 * (k + 1) + j, near_copy(base, rng, rng.choice([0, 0.01, 0.03, 0.06]))) for j in range(rng.randint(1, 6))]
        cases.append((1000 * (k + 1) + 99, f"{text(60, rng)} {passage} {text(30, rng)}"))
    return cases + [(20000 + j, passage.upper()) for j in range(5)] + [(20010, "A b C d e"), (20011, "a B c d E"), (20012, "a b c d e f"), (20013, "a b c d")]


@pytest.mark.parametrize(("tile", "first"), [(1024, 2), (6, 2), (3, 0)])
def test_ngram_join(spark, tile, first, monkeypatch):
    monkeypatch.setattr(ngram_join, "FIRST", first)  # 0: all is left to the later turns
    cases = [*{r[0]: r for r in near_cases()}.values()]
    rng = random.Random(18)
    far = text(300, rng)  # a chain of copies, each with more words replaced
    for j in range(40):
        far = near_copy(far, rng, 0.006)
        cases.append((30000 + j, far))
    out = ngram_join.jaccard_components(docs(spark, cases), tile=tile)
    assert sorted(rows(out, "doc_id", "n_shingles", "component_id")) == brute_components(cases)


def test_every_link_comes_from_the_tree_search(spark, monkeypatch):
    cases = [*{r[0]: r for r in near_cases()}.values()]
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(ngram_join, "_search", lambda rows, forests: none)
    norm = lambda t: WHITE.sub(" ", (t or "").strip(" \t\n\r\x0b\x0c").lower())
    least = {}
    for i, t in cases:
        least[norm(t)] = min(i, least.get(norm(t), i))
    out = ngram_join.jaccard_components(docs(spark, cases)).where("n_shingles > 4").collect()
    own = dict(cases)
    assert out and all(r.component_id == least[norm(own[r.doc_id])] for r in out)


@pytest.mark.parametrize("cases", [[(7, "a b c d e f"), (7, "u v w x y z"), (2, "A b c d e f"), (9, "u v w x y z 1"), (None, "u v w x y z"), (None, "p q r s t")], [(1, None), (1, None), (1, "a b")]])
def test_rows_that_share_an_id_are_nodes_of_their_own(spark, cases):
    got = rows(ngram_join.jaccard_components(docs(spark, cases)), "doc_id", "n_shingles", "component_id")
    by_row = {i: c for i, _, c in brute_components([(k, t) for k, (_, t) in enumerate(cases)])}
    name = {}
    for k, (i, _) in enumerate(cases):
        name[by_row[k]] = min((x for x in (i, name.get(by_row[k])) if x is not None), default=None)
    sizes = {k: n for k, n, _ in brute_components([(k, t) for k, (_, t) in enumerate(cases)])}
    assert got == sorted(((i, sizes[k], name[by_row[k]]) for k, (i, _) in enumerate(cases)), key=repr)
    kept = {}
    for k, (i, _) in enumerate(cases):
        kept[by_row[k]] = min(kept.get(by_row[k], (True, 0, k)), (i is None, i or 0, k))
    assert rows(ngram_join.keep_one(docs(spark, cases)), "doc_id", "text") == sorted((cases[k] for _, _, k in kept.values()), key=repr)


def test_words_hash_alike_in_long_texts(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    words = [" ".join(RNG.choice(WORDS) for _ in range(300)), "y" * 500, text(200), "z" * 65, "y" * 500]
    data = " ".join(words).encode()
    monkeypatch.setattr(ngram_join, "WIDTH", 1)
    assert len(ngram_join.shingles(data)) == len(set(data.split()))


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    assert rows(ngram_join.jaccard_components(docs(spark, [(1, None), (None, "a b"), (2, " ")])), "doc_id", "component_id") == [(1, 1), (2, 2), (None, None)]
    kept = ngram_join.keep_one(docs(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, None), (None, "a b c d e")]))
    assert rows(kept, "doc_id") == [(1,), (3,)] and "keep_id" in kept.columns


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, rng.integers(4, 90), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.08], rng.integers(0, 2**64, 3, dtype=np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    ids, vectors = np.arange(len(sets)), [ngram_join.count_vector(s) for s in sets]
    pairs, more = ngram_join._search_group(ids, n, ids, np.zeros(len(sets), int), vectors, 10**9)
    assert not more and len(pairs) == len(set(pairs)) < 100
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (n[a] + n[b] - common):
                assert (a, b) in pairs
    # Copies of one set: a forest joins them, and there are others until all components are one.
    ids, ten = np.arange(10), [vectors[0]] * 10
    pairs, more = ngram_join._search_group(ids, np.full(10, n[0]), ids, np.zeros(10, int), ten, 1)
    assert more and len(pairs) == 9 and len({k for p in pairs for k in p}) == 10
    assert ngram_join._search_group(ids, np.full(10, n[0]), np.zeros(10, int), np.zeros(10, int), ten, 1) == ([], False)
    assert sorted(ngram_join._search_group(ids, np.full(10, n[0]), ids, np.where(ids < 5, 1, 2), ten, 99)[0]) == [(a, b) for a in range(5) for b in range(5, 10)]


def words_of(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def brute_overlaps(cases, items):
    out = []
    for i, t in cases:
        for k, x in items:
            w, v, best = words_of(t), words_of(x), None
            if not v:
                continue
            wide = min(13, len(v))
            for shift in range(-len(v) + 1, len(w)):
                first, last = max(shift, 0), min(shift + len(v), len(w))
                eq = [w[p] == v[p - shift] for p in range(first, last)]
                if len(eq) >= wide and max(sum(eq[s : s + wide]) for s in range(len(eq) - wide + 1)) * 100 >= 80 * wide:
                    best = max(best or (0, 0), (sum(eq), -shift))
            if best:
                out.append((i, k, best[0], len(v), -best[1]))
    return sorted(set(out), key=repr)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, text(rng.choice([15, 20, 30, 50]), rng)) for k in range(8)] + [(8, None), (9, ""), (10, WORDS[5] + " " + WORDS[6]), *((20 + n, text(n, rng)) for n in range(3, 14)), (0, text(16, rng))]
    cases = [r for r in ODD if r[0] not in (7,)]
    for k, x in items:
        w = (x or "").split(" ")
        cases.append((100 + k, f"{text(20, rng)} {' '.join(w)}, {text(9, rng)}"))
        cases.append((200 + k, " ".join([text(5, rng), *[rng.choice(WORDS) if p % 7 == 3 else y.upper() for p, y in enumerate(w)]])))
        cases.append((300 + k, " ".join([*w[: len(w) // 3], text(30, rng)])))
        for j in range(4):  # replaced words anywhere, up to a quarter
            gone = rng.sample(range(len(w)), rng.randint(0, len(w) // 4))
            cases.append((1000 + 10 * k + j, " ".join([text(4, rng), *["zz" if p in gone else y for p, y in enumerate(w)], text(4, rng)])))
    got = rows(decontamination.overlaps(docs(spark, cases), spark.createDataFrame(items, "item_id bigint, text string")), "doc_id", "item_id", "matched_words", "item_words", "word_shift")
    merged = {}
    for r in brute_overlaps(cases, items):
        merged[r[:2]] = max(merged.get(r[:2], r), r, key=lambda x: (x[2], -x[4], x[3]))
    assert [g[:2] for g in got] == sorted(merged, key=repr)
    assert {(g[0], g[1]): g[2] for g in got} == {k: v[2] for k, v in merged.items()}
    clean = decontamination.decontaminate(docs(spark, cases), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in cases} - {g[0] for g in got}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.overlaps(docs(spark, cases), none).count() == 0
    assert decontamination.overlaps(docs(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_rows_and_items_without_an_id_are_searched(spark):
    rng = random.Random(14)
    one, two = text(20, rng), text(25, rng)
    cases = [(None, f"a b {one} c"), (None, text(30, rng)), (4, f"{two} x"), (4, text(30, rng)), (5, text(30, rng))]
    items = spark.createDataFrame([(None, one), (None, two), (3, text(20, rng))], "item_id bigint, text string")
    assert rows(decontamination.overlaps(docs(spark, cases), items), "doc_id", "item_id", "item_words") == [(4, None, len(words_of(two))), (None, None, len(words_of(one)))]
    assert rows(decontamination.decontaminate(docs(spark, cases), items), "doc_id", "text") == sorted((cases[k] for k in (1, 3, 4)), key=repr)


def test_masks_leave_no_window_without_a_hit():
    for a in range(13):
        for b in range(a, 13):
            assert any(not {a, b} & {s + p for p in m} for m in decontamination.MASKS for s in range(13 - max(m)))


def test_warc(spark, tmp_path):
    page = [(1, "http://www.b.com/x", "<p>é</p>"), (2, "http://a.com/", "same"), (3, "https://c.org:8080/q?z=1", "same"), (4, None, None), (5, "not a url\t\n", ""), (6, "http://a.com/", "same"), (6, "http://a.com/", "same"), (7, "http://b.com/x", "z" * 70000)]
    df = spark.createDataFrame(page, "page_id bigint, url string, html string").withColumn("key", F.lit(1))
    folder = f"file://{tmp_path}/w"
    warc.write(df, folder)
    last = {}
    for i, _, h in page:
        last[h or ""] = max(i, last.get(h or "", i))
    expected = []
    for i, _, h in page:
        data = (h or "").encode()
        keep = last[h or ""]
        expected.append((i, len(data), warc.payload_digest(data), "response" if keep == i else "revisit", None if keep == i else keep))
    for got in (warc.read_all(spark, folder), warc.read(spark, folder, df)):
        assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=repr)
    assert [r["page_id"] for r in warc.lookup(spark, folder, "https://b.com/x")] == [1, 7]
    assert warc.lookup(spark, folder, "http://b.com/x")[0]["payload"] == "<p>é</p>".encode()
    assert warc.lookup(spark, folder, "http://nowhere.com/") == []
    members = b"".join(p.read_bytes() for p in sorted((tmp_path / "w/archives").iterdir()))
    assert gzip.decompress(members).count(b"WARC/1.1\r\n") == len(page)
    warc.write(df.where("false"), f"{folder}-none")
    assert warc.read_all(spark, f"{folder}-none").count() == warc.read(spark, f"{folder}-none", df).count() == 0


def test_small_payloads_are_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id bigint, url string, html string")
    warc.write(df, f"file://{tmp_path}/w", least=3)
    assert rows(warc.read_all(spark, f"file://{tmp_path}/w"), "page_id", "refers_to") == [(1, None), (2, None), (3, 4), (4, None)]


def test_lookups_of_odd_urls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    urls = [f"http://h.com/a{c}b" for c in (" ", "!", "%", "%20", "\t", "~", "é", "\x7f", "", "#", '"')] + ["http://h.com/a b/c", "http://[bad", "", None, "http://h.com:80/a!b"]
    df = spark.createDataFrame([*enumerate(urls)], "page_id bigint, url string").withColumn("html", F.col("page_id").cast("string"))
    folder = f"file://{tmp_path}/w"
    warc.write(df, folder)
    assert rows(warc.read(spark, folder, df), "page_id") == sorted(((i,) for i in range(len(urls))), key=repr)
    for i, url in enumerate(urls):
        key = warc._field(warc.url_key(url or ""))
        same = [k for k, u in enumerate(urls) if warc._field(warc.url_key(u or "")) == key]
        assert [r["page_id"] for r in warc.lookup(spark, folder, url or "")] == same and i in same
        assert rows(warc.read(spark, folder, df.where(f"page_id = {i}")), "page_id") == sorted(((k,) for k in same), key=repr) if i < 3 else True


def test_index_runs_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    df = spark.createDataFrame([(i, f"http://h.com/{i % 3}", str(i)) for i in range(20)], "page_id bigint, url string, html string")
    warc.write(df, f"file://{tmp_path}/w")
    for k in range(3):
        assert [r["page_id"] for r in warc.lookup(spark, f"file://{tmp_path}/w", f"http://h.com/{k}")] == [i for i in range(20) if i % 3 == k]
    assert warc.read(spark, f"file://{tmp_path}/w", df.where("page_id < 2")).count() == 14


def test_template_is_reversible():
    pool = ["\\", "###", "#", "</turn>", "\n", "\n</turn>\n", "### assistant:\n", "a", ":", "\\n", "é", "<", "/turn>"]
    for _ in range(400):
        turns = [("".join(RNG.choice(pool) for _ in range(RNG.randint(0, 3))), "".join(RNG.choice(pool) for _ in range(RNG.randint(0, 8)))) for _ in range(RNG.randint(0, 4))]
        turns += [("assistant", "".join(RNG.choice(pool) for _ in range(6)))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError, match="no turn"):
        chat.parse("### user:\nhi")


@pytest.mark.parametrize("hot", [10_000, 3])
def test_reply_trees(spark, hot, monkeypatch):
    monkeypatch.setattr(chat, "HOT", hot)  # larger trees are joined by node
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, 0.5), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 4, "assistant", "end2", 0.5)]
    tree += [(2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "a", "x", 0.0), (3, 2, 1, "a", "y", 0.0), (None, 1, None, "user", "no tree", 1.0)]
    tree += [(4, i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(21)] + [(5, 1, None, "user", "two", 0.0), (5, 1, None, "user", None, 0.0), (5, 1, None, "assistant", "rows", 0.0)]
    df = spark.createDataFrame(tree, "tree bigint, node bigint, parent bigint, role string, text string, score double").withColumn("leaf", F.lit(1)).withColumn("up", F.lit(2))
    best = {r.tree: r for r in chat.format_paths(df).collect()}
    assert chat.parse(best[1].formatted) == [("user", "q"), ("assistant", "good"), ("user", ""), ("assistant", "end")]
    assert chat.parse(best[2].formatted) == [("user", "orphan")] and best[None].formatted and 3 not in best
    assert [t for _, t in chat.parse(best[4].formatted)] == [f"m{i}" for i in range(21)]
    assert chat.parse(best[5].formatted) == [("assistant", "rows"), ("user", ""), ("user", "two")]
    every = chat.format_paths(df, best=None)
    assert rows(every.where("tree = 1"), "leaf", "rank") == [(2, 3), (5, 1), (6, 2)]
    assert chat.format_paths(df.where("false")).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    good = [(i, text(rng.randint(5, 80), rng), 1) for i in range(n)]
    bad = [(n + i, " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text(rng.randint(5, 80), rng).split(" ")), 0) for i in range(n // 2)]
    bad += [(2 * n + i, " ".join([rng.choice(WORDS)] * 40), 0) for i in range(n // 4)]
    return good + bad


def test_quality(spark):
    learn, held = labelled(120, 1), labelled(60, 2)
    model = quality.train([(t, y) for _, t, y in learn])
    right = [(model.score(t) >= 0.7) == (y == 1) for _, t, y in held]
    assert sum(right) / len(right) > 0.95
    cases = [*ODD, *[(1000 + i, t) for i, t, _ in held]]
    got = quality.score(docs(spark, cases), model).collect()
    scores = {}
    for i, t in cases:
        scores.setdefault(i, model.score(t or ""))
    assert len(got) == len(cases) and all(abs(scores[r.doc_id] - r["score"]) < 1e-9 and 0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs(spark, []), model, keep=True).columns == [*docs(spark, []).columns, "score"]
    assert quality.train([]).score("x") == 0.5 and quality.train([("a", 1)]).score("b") > 0.9


def naive_quality(model, t):
    """The score by its definition: the average over all n-grams, one by one."""
    words, found = t.split(), []
    for w in words:
        found += quality.word_features(w)
    for a, b in zip(words, words[1:], strict=False):
        found += quality.pair_buckets(np.array([quality.word_hash(a), quality.word_hash(b)], dtype=np.uint64)).tolist()
    z = model.bias + (sum(float(model.weight[f]) for f in found) / len(found) if found else 0.0)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def test_quality_scores_are_averages_over_all_ngrams(spark):
    model = quality.train([(t, y) for _, t, y in labelled(40, 5)])
    cases = [*{r[0]: r for r in ODD}.values(), (50, "a a a b a a"), (51, "b a a a a a")]
    got = {r.doc_id: r["score"] for r in quality.score(docs(spark, cases), model).collect()}
    for i, t in cases:
        assert abs(got[i] - naive_quality(model, t or "")) < 1e-9
    assert got[50] != got[51]  # the order of words counts


def test_gradients():
    rng = np.random.default_rng(2)
    vectors, layer, bias, share = rng.normal(size=(5, 3)), rng.normal(size=(3, 2)), rng.normal(size=2), rng.dirichlet(np.ones(5))
    for y in (0, 1):
        _, *given = quality.gradients(vectors, share, layer, bias, y)
        for which, d in enumerate(given):
            for at in np.ndindex(d.shape):
                sides = []
                for e in (1e-6, -1e-6):
                    x = [vectors.copy(), layer.copy(), bias.copy()]
                    x[which][at] += e
                    sides.append(quality.gradients(x[0], share, x[1], x[2], y)[0])
                assert abs((sides[0] - sides[1]) / 2e-6 - d[at]) < 1e-6


def test_samples_are_bounded(spark):
    from spanweave.llm.samples import labelled_sample

    texts_ = docs(spark, [(1, "x" * 10)] * 50 + [(1, "short"), (2, "two"), (3, None), (4, "z" * 1000), (9, "no label")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (None, 1)], "doc_id bigint, toxic int")
    assert sorted(labelled_sample(texts_, labels, "toxic", F.lit(True), 100)) == [("", 0), ("short", 1), ("two", 0), ("z" * 1000, 0)]
    assert sorted(labelled_sample(texts_, labels, "toxic", F.lit(True), 100, most=100)) == [("", 0), ("short", 1), ("two", 0)]
    assert len(labelled_sample(texts_, labels, "toxic", F.lit(True), 4)) == 3
    assert labelled_sample(texts_, labels, "toxic", F.lit(True), 100, most=-1) == []


def naive_toxicity(lexicon, t):
    """The features by their definition: every entry at every word's beginning, exceptions by searching for them."""
    t = toxicity.fold(t)
    letter = lambda k: 0 <= k < len(t) and t[k].isalpha()
    spared = [(k, k + len(x)) for x in lexicon.exceptions for k in range(len(t)) if t.startswith(x, k) and not letter(k - 1) and not letter(k + len(x))]
    best = {}
    for k in range(len(t)):
        if letter(k - 1):
            continue
        for pattern, (weight, whole) in lexicon.entries.items():
            end = k + len(pattern)
            if t.startswith(pattern, k) and not (whole and letter(end)) and not any(a <= k and end <= b for a, b in spared):
                best[k] = max(best.get(k, (0.0, "")), (weight, pattern))
    total, words = sum(w for w, _ in best.values()), len(re.findall(r"[^\W\d_]+", t)) or 1
    return math.log1p(total), math.log1p(100 * total / words), math.log1p(len({p for _, p in best.values()}))


def test_automaton_equals_naive_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({toxicity.fold(w): (x, whole) for w, x, whole in (("scum", 2.0, True), ("trash", 1.5, False), ("tras", 1.0, False), ("loser", 1.0, True), ("idiot", 2.5, False))}, (-3.0, 1.0, 0.5, 1.0))
    automaton = lexicon.automaton()
    pool = ["scum", "scums", "5cum", "pond", "line", "trash", "tra5h", "can", "bin", "trashy", "loser", "l0ser", "sore", "id!ot", "idiot", "proof", "ѕсum", "a", "-", "x1", "!", "", "é"]
    for _ in range(500):
        t = rng.choice([" ", ""]).join(rng.choice(pool) + rng.choice(["", " ", ".", "\n"]) for _ in range(rng.randint(0, 9)))
        x = lexicon.features(toxicity.fold(t), automaton)
        assert all(abs(a - b) < 1e-12 for a, b in zip(x, naive_toxicity(lexicon, t), strict=True)), t


def test_fit_reads_only_rows_to_learn_from(spark):
    rows_ = labelled(40, 3)
    texts_ = docs(spark, [(i, t) for i, t, _ in rows_] + [(10000, None)])
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows_] + [(10000, 1, 0), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(texts_, x, F.col("doc_id") % 4 != 2, 60) for x in (labels, flipped))
    assert np.array_equal(one.weight, two.weight) and one.bias == two.bias
    assert toxicity.fit(texts_, labels.where("false"), F.lit(True)).entries == {}


def test_toxicity(spark):
    rng = random.Random(9)
    mean = ["wretch", "scoundrel", "blockhead"]

    def insult(t):
        w = t.split(" ")
        for _ in range(3):
            w.insert(rng.randrange(len(w) + 1), rng.choice(mean))
        return " ".join(w)

    make = lambda n: [(text(rng.randint(8, 60), rng), 0) for _ in range(n)] + [(insult(text(rng.randint(8, 60), rng)), 1) for _ in range(n // 2)]
    lexicon = toxicity.train(make(160), exceptions=("wretch of the sea",))
    automaton = lexicon.automaton()
    score = lambda t: lexicon.score(lexicon.features(toxicity.fold(t), automaton))
    held = make(60)
    assert sum((score(t) >= 0.7) == (y == 1) for t, y in held) / len(held) > 0.95
    filler = text(12, rng)
    assert score(f"{filler} wretch scoundrel blockhead") >= 0.7 > score(filler)
    assert score(f"{filler} wr3tch ѕсоundrel b1оckhead") >= 0.7
    assert score(f"{filler} wretch of the sea") == score(filler)
    cases = [*ODD, (50, f"{filler} wretch wretch blockhead")]
    got = toxicity.score(docs(spark, cases), lexicon).collect()
    assert len(got) == len(cases) and all(0 <= r.score <= 1 for r in got)
    assert max(got, key=lambda r: r.score).doc_id == 50
    assert toxicity.score(docs(spark, []), lexicon).count() == 0
