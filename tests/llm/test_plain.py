"""Models and their scores against plain versions: one text, one tree, one weight at a time."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import attention, common, registry, secrets, toxicity
from tessera.llm import textkit as tk


def plain_features(value, before, after):
    n, low, lead, tail = max(len(value), 1), value.lower(), before[-secrets.NEARBY :].lower(), after[: secrets.NEARBY].lower()
    share = lambda keep: sum(map(keep, value)) / n
    kind = lambda c: "d" if c in "0123456789" else "l" if c in "abcdefghijklmnopqrstuvwxyz" else "u" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "o"
    rest, words = low, sorted(secrets.DICTIONARY, key=len, reverse=True)
    covered = at = 0
    while at < len(rest):
        hit = next((w for w in words if rest.startswith(w, at)), "")
        covered, at = covered + len(hit), at + max(len(hit), 1)
    syllables = at = 0
    while at + 1 < len(low):
        found = low[at] in "bcdfghjklmnpqrstvwxz" and low[at + 1] in "aeiou"
        syllables, at = syllables + found, at + 1 + found
    near = " ".join((lead, low, tail))
    runs = any(len(set(low[i : i + 4])) == 1 and len(low[i : i + 4]) == 4 for i in range(len(low))) or any(low[i : i + 2] * 4 == low[i : i + 8] for i in range(len(low) - 7))
    names = "|".join(x.replace("_", "[_]") for x in secrets.SECRET_NAMES)
    return {
        "length": min(n, 200),
        "digits": share(lambda c: kind(c) == "d"),
        "upper": share(lambda c: kind(c) == "u"),
        "lower": share(lambda c: kind(c) == "l"),
        "symbols": share(lambda c: kind(c) == "o"),
        "transitions": sum(kind(a) != "o" and kind(a) != kind(b) for a, b in zip(value, value[1:], strict=False)) / n,
        "distinct": len(set(low)) / min(n, 36),
        "syllables": syllables / n,
        "dictionary": covered / n,
        "repeats": float(runs or any(x in low for x in ("0123", "1234", "abcd"))),
        "hexadecimal": float(bool(value) and (set(value) <= set("0123456789abcdef") or set(value) <= set("0123456789ABCDEF"))),
        "known": float(any(regex.fullmatch(p, value) for p in secrets.KNOWN_FORMATS.values())),
        "path": float(bool(re.search(r"(https?:|[\w.-]*/|\\)[^\s\"'=]*$", lead) or re.search(r"/.*/|\.[a-z]{2,4}$", value))),
        "named": float(bool(re.search(rf"(?:{names})[\"']?\s{{0,3}}([:=]|is)?\s{{0,3}}[\"']?$", lead))),
        "placeholder": float(any(w in near for w in secrets.PLACEHOLDER_WORDS)),
        "digest": float(any(re.search(rf"\b{w}", lead) and re.search(rf"\b{w}\b", lead) for w in secrets.DIGEST_WORDS)),
    }


def walk(tree, f):
    """The leaf of one printed tree: its conditions one after the other."""
    tokens, at = re.findall(r"CASE WHEN f\.(\w+) <= ([-\d.Ee]+)D THEN|(ELSE)|(END)|([\d.]+)", tree), 0

    def read(take):
        nonlocal at
        name, bound, _, _, leaf = tokens[at]
        at += 1
        if not name:
            return float(leaf) if take else None
        low = f[name] <= float(bound)
        yes = read(take and low)
        at += 1
        no = read(take and not low)
        at += 1
        return yes if low else no

    return read(True)


def test_forest_against_walking_its_trees(spark):
    rows = secrets.labelled_findings(spark, 1400)
    forest = secrets.train(rows)
    scored = rows.select("value", "before", "after", secrets.features(F.col("value"), F.col("before"), F.col("after")).alias("f")).select("value", "before", "after", "f", F.expr(forest).alias("p")).collect()
    trees = re.findall(r"CAST\((.*?) AS DOUBLE\)", forest)
    assert len(trees) == secrets.TREES
    for r in scored:
        f = plain_features(r.value, r.before, r.after)
        assert {k: round(v, 9) for k, v in f.items()} == {k: round(v, 9) for k, v in r.f.asDict().items()}, r.value
        assert math.isclose(r.p, sum(walk(t, f) for t in trees) / len(trees), abs_tol=1e-9)


def loss(x, begin, y, w):
    """Mean cross-entropy, one document and one passage at a time."""
    total = 0.0
    for i, label in enumerate(y):
        h = [np.tanh(v @ w["encode"] + w["encode0"]) for v in x[begin[i] : begin[i + 1]]]
        raw = [float((np.tanh(v @ w["tanh"]) / (1 + np.exp(-(v @ w["gate"])))) @ w["attend"]) for v in h]
        share = np.exp(raw) / np.exp(raw).sum()
        z = sum(a * v for a, v in zip(share, h, strict=True))
        p = 1 / (1 + math.exp(-float(z @ w["out"] + w["out0"])))
        total -= label * math.log(p) + (1 - label) * math.log(1 - p)
    return total / len(y)


def test_attention_against_single_passages_and_numeric_gradients():
    rng = np.random.default_rng(3)
    x, begin, y = rng.standard_normal((11, attention.FEATURES)), np.array([0, 1, 4, 9, 11]), np.array([1.0, 0.0, 0.0, 1.0])
    w = attention.fit(x, begin, y, epochs=5).weights
    p = attention._forward(x, begin, w)["p"]
    assert math.isclose(loss(x, begin, y, w), -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), rel_tol=1e-9)
    grad, step = attention.gradient(x, begin, y, w), 1e-6
    for name, value in w.items():
        value = np.asarray(value, dtype=float)
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 12)]:
            up, down = value.copy(), value.copy()
            up[at] += step
            down[at] -= step
            slope = (loss(x, begin, y, w | {name: up}) - loss(x, begin, y, w | {name: down})) / (2 * step)
            assert math.isclose(slope, np.asarray(grad[name])[at], rel_tol=1e-4, abs_tol=1e-8), (name, at)


def test_passages_are_64_words_each(spark):
    texts = ["", None, "one", " ".join(f"w{i}" for i in range(64)), " ".join(f"w{i}" for i in range(65)), "\n\t ", "x " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_passages for r in attention.predict(docs, None).collect()}
    assert got == {i: max(1, -(-len((t or "").split()) // 64)) for i, t in enumerate(texts)}


def hashed(word: bytes):
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(tk.hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def plain_chain(chain, text):
    words, out = {hashed(w.lower()) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())}, []
    for model in chain.models:
        weight = dict(zip(model.words.tolist(), model.weights, strict=True))
        z = model.bias + sum(weight.get(w, 0.0) for w in words) + sum(v * p for v, p in zip(model.earlier, out, strict=True))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_chain_against_single_words(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.train(docs, labels)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "É é ÉÉ naïve NAÏVE 1 a-b")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    got = {r.doc_id: (r.p_toxic, r.p_toxic_junk) for r in toxicity.predict(rows, chain).collect()}
    for doc_id, text in texts:
        assert np.allclose(got[doc_id], plain_chain(chain, text), atol=1e-9)


def test_folds_never_see_their_own_labels():
    """The earlier probabilities that a later model is fitted on come from models without the row: with random labels they tell nothing."""
    rng = np.random.default_rng(1)
    n = 400
    own, common_words = np.arange(n, dtype=np.uint64) + np.uint64(1000), rng.integers(0, 40, (n, 5)).astype(np.uint64)
    words = [np.unique(np.r_[common_words[i], own[i]]) for i in range(n)]
    bounds = np.r_[0, np.cumsum([len(w) for w in words])]
    y = rng.integers(0, 2, n).astype(float)
    chain = toxicity.fit(np.concatenate(words), bounds, {"a": y, "b": y})
    assert abs(float(chain.models[1].earlier[0])) < 1.0  # leaked, it would be a large weight


def test_toxicity_on_held_out_documents(spark, sf_dir):
    """On sf0.1: sf0.01 holds out a handful of toxic documents, some without any insult in them, and ranks them worse (AUC 0.82)."""
    sf = sf_dir.replace("0.001", "0.1")
    got = registry.op7_chain_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    p, y = got["p_toxic"].to_numpy(), got["toxic"].to_numpy()
    ranks = np.argsort(np.argsort(p))
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.95 and got["is_toxic"][y == 1].mean() > 0.85 and got["is_toxic"][y == 0].mean() < 0.02


def test_classifiers_take_text_keys(spark):
    docs = spark.createDataFrame([(f"k{i}", "good words here" if i % 2 else "bad!!! $$$ bad!!!") for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"k{i}", i % 2, 1 - i % 2) for i in range(40)], "doc_id string, quality int, toxic int")
    assert attention.predict(docs, attention.train(docs, labels)).count() == 40
    assert toxicity.predict(docs, toxicity.train(docs, labels, {"toxic": "toxic = 1"})).where("is_toxic").count() == 20


def test_bounds_of_the_labelled_sample(spark):
    docs = spark.createDataFrame([(1, "good words"), (2, "bad " * 100), (3, "bad"), (4, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    assert attention.train(docs, labels.where("doc_id <> 3"), max_bytes=50) is None
    assert attention.train(docs, labels, max_bytes=50) is not None


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_slices_give_every_byte():
    column = pa.array(["a", None, "b" * (tk.SLICE_BYTES + 10), "", "c"])
    seen = []
    for a, b, raw, offsets in tk.slices(column):
        seen += [bytes(raw[offsets[i] : offsets[i + 1]]).decode() for i in range(b - a)]
    assert seen == [x or "" for x in column.to_pylist()]
