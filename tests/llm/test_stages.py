"""Stages of the pipeline on rows that the tables do not have."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from tessera.llm import langid, mixing, packing
from tessera.llm.common import release

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=30):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def stage(spark, name, rows):
    docs = spark.createDataFrame([(i, t, lang, source, len(t) if t else None) for i, t, lang, source in rows], DOCS)
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "")


def test_release_gives_freed_native_memory_back(spark):
    """Blocks freed below one that is still held stay in the allocator's pools until these are trimmed."""
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"
    mb = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path(status).read_text())[1]) / 1024
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 100_000
    blocks = [unsafe.allocateMemory(size) for _ in range(2000)]
    for at in blocks:
        unsafe.setMemory(at, size, 1)
    for at in blocks[:-1]:
        unsafe.freeMemory(at)
    jvm.System.gc()
    before = mb()
    release(spark)
    assert before - mb() > 100
    unsafe.freeMemory(blocks[-1])


# -- languages ------------------------------------------------------------------------------------


def test_documents_stay_without_a_learned_language(spark):
    long = "word " * 5000
    for rows in ([(1, "some words", None, "s"), (2, "123 !", None, "s"), (3, None, None, "s")], [(1, long, "en", "s"), (2, "", "en", "s"), (4, "few words", None, "s")]):
        got = {r.doc_id: r.lang for r in stage(spark, "language_id", rows).collect()}
        assert set(got) == {i for i, t, _, _ in rows if t and any(c.isalpha() for c in t)}
        assert got[1] == rows[0][2]


def test_languages_are_learned_from_long_texts_and_distinct_rows(spark):
    rows = [(i, "kurze worte " + str(i), "de", "s", 1) for i in range(5)] + [(9, "immer gleich", "de", "s", 1)] * 400
    rows += [(20 + i, "quite long words " * (1500 + i), "en", "s", 1) for i in range(3)] + [(None, "sans cle", "fr", "s", 1)]
    model = langid.train(spark.createDataFrame(rows, DOCS), docs=6)
    assert model.languages == ["de", "en", "fr"]
    got = langid.predict(spark.createDataFrame([(1, "quite long", None, "s", 1), (2, "kurze worte", None, "s", 1)], DOCS), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["en", "de"]


# -- near duplicates ------------------------------------------------------------------------------


def test_unlike_texts_with_one_id_stay(spark):
    near = text(1) + " more"
    rows = [(7, text(k), None, "s") for k in (1, 2, 3)]  # one id, three unlike texts
    rows += [(7, text(2), None, "s"), (3, near, None, "s")]  # a repeated row; 3 represents the group of text 1
    rows += [(9, text(3), None, "s"), (None, text(3), None, "s")]  # 7 represents the group of text 3; no id stays
    got = Counter((r.doc_id, r.text) for r in stage(spark, "near_duplicates", rows).collect())
    assert got == Counter([(3, near), (7, text(2)), (7, text(3)), (None, text(3))])


def test_a_hot_id_keeps_its_texts(spark):
    rows = [(5, text(k), None, "s") for k in range(40)] + [(100 + k, text(40 + k), None, "s") for k in range(80)]
    got = stage(spark, "near_duplicates", rows + [(1, text(0), None, "s")]).collect()
    assert len(got) == 120 and sum(r.doc_id == 5 for r in got) == 39


# -- mixing and packing -----------------------------------------------------------------------------


def test_sequences_follow_the_mixture(spark):
    rows = [(i, text(i, 5), None, f"s{min(i % 10, 2)}") for i in range(3000)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], DOCS)
    position = {r.doc_id: r.mix_position for r in mixing.mix(docs).select("doc_id", "mix_position").collect()}
    got = packing.pack(mixing.mix(packing.measured(docs)), order="mix_position", group_rows=256).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    groups = defaultdict(list)
    for r in got:
        groups[r.bin_id >> 32].append(r)
    last = -1
    for g in sorted(groups):
        at = [position[r.doc_id] for r in groups[g]]
        assert min(at) > last and len(at) <= 512
        last = max(at)
        first = defaultdict(list)
        for r in groups[g]:
            first[r.bin_id].append(position[r.doc_id])
        starts = [min(first[b]) for b in sorted(first)]
        assert starts == sorted(starts)


def test_mixture_decides_the_pipelines_sequences(spark):
    rows = [(i, text(i, 5), None, f"s{min(i % 10, 2)}") for i in range(2000)]
    position = {r.doc_id: r.mix_position for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    bins = defaultdict(list)
    for r in stage(spark, "best_fit_packing", rows).collect():
        bins[r.bin_id].append(position[r.doc_id])
    starts = [min(bins[b]) for b in sorted(bins)]
    assert starts == sorted(starts)


def test_packing_groups_are_bounded_for_repeated_and_null_keys(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(i, 5), None, f"s{i % 9}", 1) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), group_rows=500).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert max(Counter(r.bin_id >> 32 for r in got).values()) < 800
