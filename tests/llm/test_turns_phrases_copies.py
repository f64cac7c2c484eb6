"""Turn repair, phrase mining and exact duplicates against plain versions."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import product

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowtide.llm import collocations, fingerprints, turn_repair
from flowtide.llm.double_array import DoubleArray


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# Exact duplicates -------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60, unique=True))
def test_golomb_code_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    shift, code = fingerprints.golomb_encode(values)
    assert (fingerprints.golomb_decode(len(values), shift, code) == values).all()


def test_golomb_code_is_short():
    values = np.unique(np.random.default_rng(3).integers(0, 2**40, 10_000, dtype=np.uint64))
    _, code = fingerprints.golomb_encode(values)
    assert len(code) * 8 / len(values) < np.log2(2**40 / len(values)) + 2


def copies(docs):
    groups, key = defaultdict(list), lambda t: (t or "").translate(brute.LOWER)
    for d, t in docs:
        groups[key(t)].append(d)
    least = lambda d: (d is not None, d)
    return [(d, max(groups[key(t)], key=least), len(groups[key(t)]), brute.sha(key(t))) for d, t in docs]


@pytest.mark.parametrize("frame", ["edge", "odd", "documents", "empty"])
def test_exact_duplicates_match_plain(frame, request):
    df = request.getfixturevalue(frame)
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = fingerprints.exact_duplicates(df.repartition(5), owner_rows=7)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(copies(docs), key=repr)
    assert got.where("kept").count() == len({c[3] for c in copies(docs)})
    assert got.where("kept AND NOT doc_id <=> keep_id").isEmpty()


def test_a_hot_text_and_upper_case(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot Ä' WHEN id % 3 = 1 THEN 'hOT Ä' ELSE concat('own ', id) END AS text")
    got = fingerprints.exact_duplicates(df.repartition(7))
    hot = got.where("group_size > 1")
    assert [tuple(r) for r in hot.select("keep_id", "group_size").distinct().collect()] == [(5998, 4000)]
    assert got.where("kept").count() == 2001
    small = spark.createDataFrame([(1, "Ä"), (2, "ä")], "doc_id bigint, text string")
    assert fingerprints.exact_duplicates(small).where("kept").count() == 2


def test_dropping_keeps_columns(odd):
    got = fingerprints.drop_exact_duplicates(odd)
    texts = [(r.text or "").translate(brute.LOWER) for r in got.collect()]
    assert got.columns == odd.columns and len(texts) == len(set(texts))
    assert set(texts) == {(r.text or "").translate(brute.LOWER) for r in odd.collect()}


# Turn repair ------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(conversation):
    seen, out = set(), []
    for role, text in conversation:
        core = text.rstrip(brute.SPACE)
        out.append(1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def all_repairs(conversation):
    """(cost, audit, turns) of every choice of one edit a row and up to two inserts before each and at the end."""
    choices = []
    inserts = [[]] + [[("I", r, "", 5)] for r in ("user", "assistant")] + [
        [("I", a, "", 5), ("I", b, "", 5)] for a, b in product(("user", "assistant"), repeat=2)]
    for (role, text), fault in zip(conversation, faults(conversation)):
        late = 5 if fault == 3 else 0
        row = [("D", None, None, 2)]
        if fault not in (1, 2):
            row += [("K", role, text, late), ("R", "user", text, 1 + late), ("R", "assistant", text, 1 + late)]
        choices += [inserts, [[r] for r in row]]
    for pick in product(*choices, inserts):
        edits = [e for part in pick for e in part]
        turns = [(r, t) for letter, r, t, _ in edits if letter != "D"]
        if GOOD.match("".join(r[:1] or "?" for r, _ in turns)):
            yield sum(e[3] for e in edits), "".join(e[0] for e in edits), turns


def plain_repair(conversation):
    cost, audit, turns = min(all_repairs(conversation), key=lambda x: x[:2])
    return cost, audit, brute.sha("\n".join(f"{r}:{t}" for r, t in turns))


def test_repair_equals_the_best_of_all(spark):
    rng = random.Random(4)
    made = {}
    for c in range(60):
        made[c] = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", ""]),
                    rng.choice(["Yes.", "No!", "cut", " \n", "", "So? ", "a.b", "ü."])) for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame([(c, t, r, x) for c, v in made.items() for t, (r, x) in enumerate(v)], TURNS)
    got = {r.conv_id: r for r in turn_repair.repair_conversations(df.repartition(5)).collect()}
    assert len(got) == 60
    for c, v in made.items():
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == plain_repair(v), v
        f, initials = faults(v), [r[:1] for r, _ in v]
        assert (got[c].blank, got[c].duplicate, got[c].truncated) == tuple(f.count(k) for k in (1, 2, 3))
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def test_repair_of_nulls_ties_and_clashing_columns(spark):
    data = [(None, 1, "user", "Hi."), (None, None, "system", "Be kind."), (None, 2, "assistant", "Hello."), (1, None, None, None),
            (1, None, None, None), (2, 5, "user", "A."), (2, 5, "assistant", "B."), (2, 9, "user", "A.")]
    df = spark.createDataFrame(data, TURNS)
    for name in ("key", "number", "fault", "initial", "first", "kind", "edits", "gaps"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.conv_id: r.asDict() for r in turn_repair.repair_conversations(df).collect()}
    assert (got[None]["audit"], got[None]["gaps"], got[None]["cost"]) == ("KKK", 0, 0)
    assert (got[1]["audit"], got[1]["blank"], got[1]["gaps"], got[1]["cost"]) == ("DD", 2, 0, 4)
    # Rows of one turn are read by role: the assistant comes first, so both change places, and the user's repeated turn goes.
    assert (got[2]["audit"], got[2]["gaps"], got[2]["duplicate"]) == ("RRD", 3, 1)
    assert turn_repair.repair_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_a_giant_conversation_goes_over_pieces_and_batches(spark):
    n = 3 * turn_repair.PIECE + 100
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role",
                                   "concat('Turn ', id, CASE WHEN id = 20001 THEN '' ELSE '.' END) AS text")
    got = turn_repair.repair_conversations(df).first()
    # Only the cut turn costs: both ways out (keep it, or delete the pair) cost 4 at least.
    assert (got.cost, got.truncated, got.gaps) == (4, 1, 0)
    assert got.audit == "K" * 20000 + "DD" + "K" * (n - 20002)
    kept = [f"{'assistant' if i % 2 else 'user'}:Turn {i}." for i in range(n) if i not in (20000, 20001)]
    assert got.repaired_sha256 == brute.sha("\n".join(kept))


def test_damage_leaves_defined_rows(spark):
    df = spark.createDataFrame([(c, t, "assistant", "A.b! c?") for c in range(20) for t in range(20)], TURNS)
    import zlib

    want = Counter()
    for c in range(20):
        for t in range(20):
            k = zlib.crc32(f"{c}:{t}".encode()) % 20
            if k:
                row = (c, t, "user" if k == 4 else "assistant", "" if k == 1 else "Ab c" if k == 2 else "A.b! c?")
                want[row] += 2 if k == 3 else 1
    assert Counter(tuple(r) for r in turn_repair.damage(df).collect()) == want


# Phrases ----------------------------------------------------------------------------------------------------------


def plain_phrases(docs, least, percent, top):
    """docs: (lang, text) -> rows of mine_phrases."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        around = Counter()
        for q, b in some.items():
            for p in (q[:2], q[1:]) if len(q) == 3 else ():
                around[p] = max(around[p], b)
        kept = {p: a for p, a in some.items() if p not in around or 100 * around[p] < percent * a}
        scored = []
        for p, a in kept.items():
            s, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, n[lang], -s))
    return sorted(out, key=repr)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("frame, least", [("edge", 2), ("odd", 2), ("empty", 2), ("documents", 4)])
def test_phrases_match_plain(frame, least, request, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_PHRASES", 300)
    df = request.getfixturevalue(frame)
    if frame == "documents":
        df = df.where("n_chars < 3000")
    docs = [tuple(r) for r in df.select("lang", "text").collect()]
    got = collocations.mine_phrases(df, least=least, percent=50, top=40)
    assert rows(got, *COLUMNS) == plain_phrases(docs, least, 50, 40)


def test_phrases_in_pieces_overlaps_and_long_words(spark):
    word = "w" * 300
    data = [("en", "a a a a, b c\tb c. B C"), (None, f"{word} x {word} x"), ("und", f"{word} x"), ("en", None), ("en", "")]
    df = spark.createDataFrame(data, "lang string, text string")
    got = collocations.mine_phrases(df, least=2, percent=101, top=None)
    assert rows(got, *COLUMNS) == plain_phrases(data, 2, 101, None)
    by = {(r.lang, r.phrase): r.a for r in got.collect()}
    assert by[("en", "a a")] == 3 and by[("en", "b c")] == 3 and by[("und", f"{word} x")] == 3


def test_a_text_is_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 20)
    monkeypatch.setattr(collocations, "PORTION", 8)
    text = b"one two three. four five six seven eight nine ten eleven twelve thirteen. one two, x"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, b"a b"], pa.binary())], ["lang", "text"])
    got = [(lang, " ".join(words[i].decode() for i in numbers)) for lang, words, numbers in collocations._portions([batch])]
    read = " ".join(t for lang, t in got if lang == "en")
    assert re.findall(r"[^ .]+", read) == re.findall(rb"[^ .,]+".decode(), text.decode())
    assert "eight nine ten eleven twelve thirteen" in read and len(got) > 2


def test_double_array_counts_what_plain_counting_does():
    rng = np.random.default_rng(2)
    for n_words, size in ((4, 30), (700, 5000)):
        phrases = rng.zipf(1.3, (size, 3)) % n_words + 1
        phrases[rng.random(size) < 0.5, 2] = 0
        both = np.unique(np.column_stack([rng.integers(0, 2, size), phrases]), axis=0)
        trie = DoubleArray.of(DoubleArray.build(both[:, 0], both[:, 1:], n_words).parts())
        text = (rng.zipf(1.3, 20_000) % n_words + 1).astype(np.int32)
        text[rng.random(len(text)) < 0.1] = 0
        totals = np.zeros(len(both), np.int64)
        trie.count(1, np.arange(n_words + 1, dtype=np.int32), text, 3, totals)
        seq, seen = text.tolist(), Counter()
        for i in range(len(seq)):
            for k in (2, 3):
                part = tuple(seq[i:i + k])
                if len(part) == k and 0 not in part:
                    seen[part + (0,) * (3 - k)] += 1
        assert totals.tolist() == [seen[tuple(p)] if root == 1 else 0 for root, *p in both.tolist()]


def test_phrase_tables_stay_below_the_texts(documents, monkeypatch, tmp_path):
    """What lies on disk while phrases are mined: no stored table is as large as the texts, letters hold few bytes a phrase."""
    from flowtide.llm.spark_help import Shelf

    sizes, put = {}, Shelf.put

    def measured(self, df, name, *rest, **named):
        got = put(self, df, name, *rest, **named)
        folder = self.folder.removeprefix("file:")
        sizes[name] = sum(os.path.getsize(f"{folder}/{name}/{f}") for f in os.listdir(f"{folder}/{name}") if f.endswith(".parquet"))
        return got

    monkeypatch.setattr(Shelf, "put", measured)
    texts = documents.selectExpr("sum(octet_length(text))").first()[0]
    assert collocations.mine_phrases(documents.coalesce(1), least=4, percent=50, top=40).count() > 0
    assert max(sizes.values()) < texts, (sizes, texts)


def test_letters_of_phrases_and_counts_come_back():
    rng = np.random.default_rng(5)
    words = pa.array([b"."] + [f"word{i}".encode() for i in range(900)], pa.binary())
    found = [c.astype(np.int64) for c in np.unique(rng.integers(1, 901, (3, 20_000)), axis=1)]
    found[2][rng.random(len(found[2])) < 0.4] = 0
    found = list(np.unique(np.stack(found), axis=1))
    own, entries, shift, code = collocations._written(words, *found)
    assert entries == len(found[0]) and len(code) < 5 * entries
    got = np.stack(collocations._read(len(own), entries, shift, code))
    text = [None, *own.to_pylist()]
    want = {tuple(words[int(w)].as_py() if w else None for w in p) for p in zip(*found)}
    assert {tuple(text[w] for w in p) for p in got.T} == want and got.shape[1] == len(want)
    for dtype, most in ((np.uint16, 65_535), (np.int64, 2**40)):
        places = np.flatnonzero(rng.random(50_000) < 0.1)
        times = np.where(rng.random(len(places)) < 0.8, 1, rng.integers(1, most, len(places))).astype(dtype)
        back = collocations._unpacked(collocations._sparse(places, times), dtype)
        assert (back[0] == places).all() and (back[1] == times).all()
    empty = collocations._unpacked(collocations._sparse(np.zeros(0, np.int64), np.zeros(0, np.int64)), np.int64)
    assert len(empty[0]) == len(empty[1]) == 0


def test_merged_letters_hold_each_phrase_once(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "LETTER", 30)
    rng, want, rows_ = np.random.default_rng(6), {}, []
    for letter in range(40):
        lang = "de" if letter >= 20 else "en"
        words = pa.array([b"."] + [f"w{k}".encode() for k in rng.permutation(12)], pa.binary())
        phrases = np.unique(rng.integers(1, 13, (20, 3)), axis=0)
        phrases[::3, 2] = 0
        phrases = np.unique(phrases, axis=0)
        own, entries, shift, code = collocations._written(words, *phrases.T)
        rows_.append((1, lang, own.to_pylist(), entries, shift, code))
        want.setdefault(lang, set()).update(tuple(words[int(w)].as_py() if w else None for w in p) for p in phrases)
    types = [pa.int32(), pa.string(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), types)], ["bucket", "lang", "words", "entries", "shift", "code"])
    got = [tuple(r.values()) for b in collocations._merged([batch]) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == {(lang, *p) for lang, v in want.items() for p in v}


@pytest.mark.parametrize("own_bits", [2, 23])
def test_letters_with_times_are_summed_in_their_bucket(monkeypatch, own_bits):
    """Letters of several tasks and two languages, tries of a few phrases, counters that let everything pass or little."""
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "BLOCK_PHRASES", 7)
    monkeypatch.setattr(collocations, "OWN_BITS", own_bits)
    rng, want, rows_ = np.random.default_rng(8), Counter(), []
    for letter in range(30):
        lang = "de" if letter >= 20 else "en"
        words = pa.array([b"."] + [f"w{k}".encode() for k in rng.permutation(9)], pa.binary())
        phrases = rng.integers(1, 10, (25, 3))
        phrases[::3, 2] = 0
        phrases = np.unique(phrases, axis=0)
        times = rng.zipf(1.5, len(phrases)).clip(max=10**6)
        own, entries, shift, code = collocations._written(words, *phrases.T)
        more = np.flatnonzero(times > 1)
        rows_.append((3, lang, own.to_pylist(), entries, shift, code, collocations._sparse(more, times[more] - 1)))
        for p, n in zip(phrases, times.tolist()):
            want[(lang, *(words[int(w)].as_py() if w else None for w in p))] += n
    types = [pa.int32(), pa.string(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), types)],
                                       ["bucket", "lang", "words", "entries", "shift", "code", "times"])
    got = [tuple(r.values()) for b in collocations._merged([batch], least=4) for r in b.to_pylist()]
    assert len(got) == len({r[:4] for r in got})
    assert {r[:4]: r[4] for r in got} == {p: n for p, n in want.items() if n >= 4}


def test_more_candidates_cost_no_further_passes(documents, monkeypatch):
    """The texts' words are read as often with tries of 50 phrases as with one trie for all."""
    kind, passes, run = type(documents), [], type(documents).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: passes.append(1) or run(self, *a, **b))
    counts = []
    for phrases in (10**6, 50):
        monkeypatch.setattr(collocations, "BLOCK_PHRASES", phrases)
        passes.clear()
        assert collocations.mine_phrases(documents.where("n_chars < 3000"), least=4, top=40).count() > 0
        counts.append(len(passes))
    assert counts[0] == counts[1]


def test_counters_grow_with_the_text_up_to_a_bound():
    assert [collocations._bits(n) for n in (0, 10**6, 85_000_000, 300_000_000, 10**9, 10**12)] == [26, 26, 26, 28, 28, 28]
