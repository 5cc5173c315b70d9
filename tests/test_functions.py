import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import code, cron, embed, media_refs, strings, text, vectors
from tessera.policy import Expansion, InvalidRequest, SearchOptions, ShardingPolicy, parse_mode, validate_query


def test_chunks_of_a_small_text():
    assert text.split("  hello hello world", 10) == [(0, "hello", 2, 7), (1, "hello", 8, 13), (2, "world", 14, 19)]
    assert text.split("   \n ", 10) == [] and text.split(None) == []
    assert text.split("One. Two. Three.", 9) == [(0, "One. Two.", 0, 9), (1, "Three", 10, 15)]  # the last stop has no part after it


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.\n日 ", max_size=300), st.integers(4, 60))
def test_chunk_invariants(whole, size):
    raw, last = whole.encode(), 0
    for _, t, a, b in text.split(whole, size):
        assert len(t.encode()) <= max(size, 4)
        assert 0 <= a <= b <= len(raw)
        if raw[a:b] == t.encode() and a >= last:
            last = b


def test_code_chunks_start_at_the_first_symbol():
    got = code.code_chunks("import x\n\ndef f(a):\n  return 1\n\nclass B:\n  pass\n", "python")
    assert got == [("def f(a):\n  return 1", "f", "function", 3, 5), ("class B:\n  pass", "B", "class", 6, 7)]
    assert code.symbol("func (s *T) Run(x int) {", "go") == ("Run", "function")
    assert code.symbol("export const go = () => 1", "typescript") == ("go", "function")
    assert code.symbol("pub fn main() {", "rust") == ("main", "function")
    assert code.code_chunks("plain\ntext", None) == [("plain\ntext", "", "", 1, 2)]


def test_long_lines_are_cut_between_characters():
    got = code.code_chunks("é" * 1000, None, 100, 20)
    assert len(got) > 10 and all(len(c[0].encode()) <= 100 for c in got)


def test_embedder_is_deterministic_unit_and_near_for_shared_words():
    a, b, c = (embed.vector(t, 256) for t in ("running quickly home", "runner quick homes", "zebra pictures"))
    assert abs(np.linalg.norm(a) - 1) < 1e-6 and np.array_equal(a, embed.vector("running quickly home", 256))
    assert a @ b > a @ c
    assert embed.vector("the and of") is None and embed.vector(None) is None
    assert len(embed.STOPWORDS) == 123


def test_remote_embedder_restores_the_order():
    run = embed.remote(lambda body: {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))]}, "m")
    assert run(["a", "b", "c"]) == [[0.0], [1.0], [2.0]]


def test_default_jobs():
    assert cron.DEFAULT_JOBS["shard-gc"] == "*/2 * * * *" and cron.DEFAULT_JOBS["event-cleanup"] == "0 */6 * * *" and len(cron.DEFAULT_JOBS) == 7
    assert all(cron.fields(x) for x in cron.DEFAULT_JOBS.values())


def test_cron():
    assert cron.fields("@daily") == [{0}, {0}, set(range(1, 32)), set(range(1, 13)), set(range(7))]
    assert cron.fields("*/20 1-3 1,5 * 0")[0] == {0, 20, 40}
    for bad in ("* * *", "61 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *"):
        with pytest.raises(InvalidRequest):
            cron.fields(bad)


def test_globs_and_paths(spark):
    rows = [("src/a/b.go",), ("b.go",), (".env",), ("node_modules/x.js",), ("conf/My-Secret.txt",)]
    df = spark.createDataFrame(rows, "path string")
    got = df.select(
        "path",
        strings.matches_any("path", ["src/**/*.go"]).alias("deep"),
        strings.matches_any("path", ["*.go"]).alias("base"),
        strings.matches_any("path", ["node_modules/**"]).alias("dir"),
        strings.secret_path("path").alias("secret"),
        strings.language("path").alias("lang"),
    ).collect()
    assert [r.deep for r in got] == [True, False, False, False, False]
    assert [r.base for r in got] == [True, True, False, False, False]
    assert [r["dir"] for r in got] == [False, False, False, True, False]
    assert [r.secret for r in got] == [False, False, True, False, True]
    assert [r.lang for r in got][:2] == ["go", "go"]


def test_binary_sniff(spark):
    cut = ("x" * 8191).encode() + "é".encode()[:1]
    rows = [(b"plain text",), (b"a\x00b",), (b"\xff\xfe\xfa",), (bytes([1, 2, 3, 4]) + b"abc",), (b"",), (cut,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(strings.is_binary("c")).collect()]
    assert got == [False, True, True, True, False, False]


def test_media_references(spark):
    df = spark.createDataFrame([("[]",), (None,), ("not json",), ('[{"media_id":"m","role":"x"}]',)], "t string")
    got = [r[0] for r in df.select(media_refs.decoded("t")).collect()]
    assert got[:3] == [None, None, None] and got[3][0].media_id == "m"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(vectors.l2("a", "b").alias("d"), vectors.normalised("a").alias("n"), vectors.normalised("b").alias("z"), vectors.to_text("a").alias("t")).first()
    assert r.d == 5.0 and [round(x, 6) for x in r.n] == [0.6, 0.8] and r.z is None and r.t == "[3.000000, 4.000000]"
    with pytest.raises(Exception, match="vector dimension"):
        df.select(vectors.of_dimension("a", 3)).collect()


def test_vector_text_rounds_halves_to_even_and_keeps_signs(spark):
    rng = np.random.default_rng(1)
    halves = [k / 128 for k in range(-129, 130, 2)] + [1023.9921875, -131071.9921875, 2.0**-149, -0.0, -1e-7, 4.9e-7, 5e-7, -5e-7, 3.25, 16777215.0]
    row = [float(np.float32(x)) for x in [*halves, *rng.normal(size=2000), *rng.normal(size=500) * 1e-6, *rng.normal(size=500) * 1e5]]
    t = spark.createDataFrame([(row,)], "a array<float>").select(vectors.to_text("a")).first()[0]
    assert t == "[" + ", ".join(f"{x:.6f}" for x in row) + "]"
    first = [-2e-6, -0.0, 2e-6, -1.234565, 0.015625, -0.015625]
    got = [str(r[0]) for r in spark.createDataFrame([(x,) for x in first], "x double").select(vectors.rounded_signed(F.col("x"), 5)).collect()]
    assert got == ["-0.0", "-0.0", "0.0", "-1.23457", "0.01563", "-0.01563"]


def test_options():
    assert Expansion(hops=0, alpha=0.0).normalised(5) == Expansion(10, 0, 25, 0.0, 0.7, 1000, ())
    assert Expansion(hops=-1, alpha=2.0, decay=0, max_neighbors=0).normalised(50).seed_k == 50
    assert parse_mode(" GRAPH ") == "graph" and parse_mode(None) == "vector"
    for bad in (lambda: SearchOptions(top_k=0).normalised(), lambda: SearchOptions(max_distance=0.0).normalised(), lambda: parse_mode("x"), lambda: validate_query([])):
        with pytest.raises(InvalidRequest):
            bad()
    assert ShardingPolicy().fanout_for(3) == 3 and ShardingPolicy().fanout_for(30) == 4


def test_page_token_round_trip(spark):
    df = spark.createDataFrame([("med_0001",)], "id string").withColumn("t", strings.page_token("id"))
    assert df.select(strings.page_position("t")).first()[0] == "med_0001"
    assert F is not None
