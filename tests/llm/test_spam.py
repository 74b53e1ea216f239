import random

import numpy as np

from lodegraph.llm.queries import QUERIES
from lodegraph.llm.spam import ALL, CHI2, NAMES, fit_direction, made_up_pages, measure, page_features, robust_model, spam_direction, spam_pages, tokens_of, whitened

LABELS = "doc_id bigint, label string"
DOCS = "doc_id bigint, text string, lang string, score double, key string"
NOUNS = "harbour ledger counter window recording sketch bakery compass policy ferry lantern archive".split()
VERBS = "covers holds changes supports replaces follows names keeps".split()


def prose(rnd, n):
    out = []
    for _ in range(n):
        a, b = rnd.sample(NOUNS, 2)
        out.append(rnd.choice([f"The {a} in the {b} room {rnd.choice(VERBS)} what we had not expected.", f"It took {rnd.randrange(90)} attempts to find the {a} because the {b} was closed.", f"Nobody knew why the {a} of the {b} is here."]))
    return "\n\n".join(out)


def spam(rnd, n):
    k = " ".join(rnd.sample(NOUNS, 2))
    kind = rnd.randrange(5)
    if kind == 0:
        return ", ".join(rnd.choice([k, f"best {k}", f"cheap {k}", f"{k} online"]) for _ in range(8 * n))
    if kind == 1:
        return "\n".join(f"https://www.{rnd.choice(NOUNS)}.example/{rnd.choice(NOUNS)}" for _ in range(2 * n))
    if kind == 2:
        return " ".join(f"#{rnd.choice(NOUNS)}{rnd.choice(NOUNS)}" for _ in range(6 * n))
    if kind == 3:
        return "\n".join(f"SKU-{rnd.randrange(9999):04}A {k} {rnd.randrange(90)}.99 add to cart #sale" for _ in range(2 * n))
    return " ".join(f"Order {k} online, compare {k}, enjoy {k}." for _ in range(2 * n))


def corpus(seed, n):
    rnd = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        bad = rnd.random() < 0.1
        text = spam(rnd, 8) + ("\n\n" + prose(rnd, 1) if rnd.random() < 0.5 else "") if bad else prose(rnd, rnd.randrange(2, 9)) + ("\n\n- https://a.example/x" if rnd.random() < 0.2 else "")
        rows.append((i, text, rnd.choice(["en", "EN", None, "en-XX", "de"]), 0.0, "k"))
        if bad:
            truth.add(i)
    return rows, truth


def flagged(spark, rows, labels=()):
    out = spam_pages(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(labels), LABELS))
    return {r["doc_id"] for r in out.collect()}


def test_held_out(spark):
    rows, truth = corpus(5, 600)
    rows += [(1000, None, "en", None, None), (1001, "", "en", None, None), (1002, " \n\t ", None, None, None)]
    rnd = random.Random(6)
    labels = [(i, "spam" if (i in truth) != (rnd.random() < 0.08) else "ok") for i in range(200)] + [(5, "spam"), (5, "ok"), (6, "unsure"), (7, None), (99_999, "spam")]
    for taught in (labels, ()):
        got = flagged(spark, rows, taught)
        hit = len([i for i in got if i >= 200 and i in truth])
        assert hit >= 0.9 * len([i for i in truth if i >= 200]) and len(got - truth) <= 2
        assert not got & {1000, 1001, 1002}


def test_repeats_and_extremes(spark):
    rows, _ = corpus(7, 120)
    page = "cheap ledger, best ledger, ledger online, " * 30
    rows += [(500, page, "en", None, None), (501, page, "en", None, None), (502, page * 800, "en", None, None), (503, "x", None, None, None), (504, "?!", "und", None, None), (505, "12 13 14", "", None, None)]
    got = flagged(spark, rows)
    assert {500, 501, 502} <= got and not got & {503, 504, 505}


def test_empty_tables(spark):
    assert flagged(spark, []) == set()
    assert flagged(spark, [], [(1, "spam")]) == set()


def told(text):
    (language,), values = measure(tokens_of([text]))
    return language, dict(zip(NAMES, values[0]))


def test_features():
    language, v = told("The harbour of the ferry is not what we had expected, and nobody knew why it is here.")
    assert language == "en" and v["link"] == v["tag"] == v["bare"] == v["repeat"] == 0 and v["function"] > 0.4
    assert told("https://a.example/b\n[[x]]\r\n[[y|z]]")[1]["link"] == 1.0
    assert told("- https://a.example/b - The note on it says that we have moved the ferry to the harbour")[1]["link"] == 0.0
    assert told("#a #b#c #d")[1]["tag"] == 1.0
    assert told("没有人知道目录为什么改名。索引里缺少记录。")[0] == "zh" and told("新しい目次を隣に置く。誰もその理由を覚えていない。")[0] == "ja"
    v = told("cheap ledger, best ledger, ledger cheap, ledger online " * 9)[1]
    assert v["repeat"] == 1.0 and v["bare"] == 1.0 and v["top"] > 0.9
    assert told("?!")[0] == told("12")[0] == ALL and (measure(tokens_of(["", "?!"]))[1] >= 0).all()


def test_features_in_slices_and_as_in_the_jvm(spark):
    pages = sum(made_up_pages(), []) + [prose(random.Random(i), 5) for i in range(30)]
    rows = [(i, x, None, 0.0, "k") for i, x in enumerate(pages)]
    got = {r["key"]: [r[x] for x in NAMES] for r in page_features(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect()}
    _, want = measure(tokens_of(pages))
    assert np.allclose([got[i] for i in range(len(pages))], want)


def test_direction():
    rnd = np.random.default_rng(3)
    target = (rnd.random(400) < 0.3).astype(float)
    white = rnd.normal(0, 2, (400, len(NAMES))) + np.outer(target * 30 + 5, np.eye(len(NAMES))[2])
    wrong = np.where(rnd.random(400) < 0.1, 1 - target, target)
    direction, offset = fit_direction(white, wrong, np.ones(400))
    assert abs(np.linalg.norm(direction) - 1) < 1e-9 and direction[2] > 0 and offset > 0
    assert ((white @ direction > offset) == target).mean() > 0.99


def test_distance_and_direction_are_both_needed(spark):
    """Without the direction honest outliers are flagged, without the distance ordinary pages are; both together do better than either."""
    rows, truth = corpus(8, 900)
    rnd = random.Random(9)
    for i in range(900, 980):  # honest outliers: code and records
        code = "\n".join(f"def {rnd.choice(NOUNS)}_{n}({rnd.choice(NOUNS)}): return {rnd.choice(NOUNS)}[{n}] * {rnd.randrange(99)}" for n in range(12))
        records = "\n".join(f"{n};{rnd.choice(NOUNS)}-{rnd.randrange(999)};{rnd.random():.4f};{rnd.choice(VERBS)}{rnd.randrange(999)}" for n in range(20))
        rows.append((i, code if i % 2 else records, None, 0.0, "k"))
    table = page_features(spark.createDataFrame(rows, DOCS), "doc_id", "text").toPandas()
    model = robust_model(spark.createDataFrame(table))
    values, langs = table[NAMES].to_numpy(), table["lang"].tolist()
    spam = table["key"].isin(truth).to_numpy()
    labelled = table["key"].to_numpy() % 4 == 0
    white = whitened(model, langs, values)
    far = (white**2).sum(1) > CHI2
    direction, offset = spam_direction(model, [x for x, m in zip(langs, labelled) if m], values[labelled], spam[labelled].astype(float))
    unit = white / np.linalg.norm(white, axis=1, keepdims=True).clip(1e-9)
    cosine, edge = fit_direction(unit[labelled & far], spam[labelled & far].astype(float), np.ones((labelled & far).sum()))

    def quality(flag):
        hit = (flag & spam & ~labelled).sum()
        return 2 * hit / ((flag & ~labelled).sum() + (spam & ~labelled).sum())

    both = quality(far & (white @ direction > offset))
    assert both >= 0.95
    assert quality(far) <= both - 0.1 and quality(unit @ cosine > edge) <= both - 0.1


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    assert QUERIES["p8_found"](spark, d).columns == ["doc_id"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert page_features(docs, "doc_id", "text").count() <= docs.count()
