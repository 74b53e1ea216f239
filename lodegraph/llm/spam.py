"""Keyword-stuffed and link-list pages by robust Mahalanobis distance.

Each text gives ten numbers: densities (links, tags, numbers, lines), repetition (the share of text in lines of repeated
words, the share of the commonest words that recur), entropy and distinct words, and function words (their share, and the share of
text in lines without them). By language a robust centre (medians) and a robust scatter (covariance of values wrapped at
2.5 robust deviations) are made over all documents whose function words tell it, drawn towards those of all documents as
far as a language has few; texts that tell no language are judged by the norm over all. Whitened by that norm, the length
of a page's deviation is its Mahalanobis distance. A page is an outlier beyond a chi-square quantile of the squared
distance, and it is flagged if it lies far enough in the spam direction: the distance times the cosine to that direction is
above an offset. Direction and offset are fitted among outliers only, on reviewed labels and, with the weight of a few of
them, on made-up pages that are what the definition names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.similar import slices
from lodegraph.session import cut, ship, spread

# Common function words, one list a language.
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for from with and or but so if then than as that this these those it its is are was were be been being has have had do does did not no nor will would can could should may might must we you he she they our your his her their i us them my me who which what when where why how there here once until before after because although into about over under again still only both each every all some any nobody knew says".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn weil dass als wie auf in im an am aus bei mit nach von vom zu zum zur für über unter ohne um noch nicht kein keine ist sind war waren wird werden wurde wurden hat haben hatte soll sollen kann können wir sie er es ich ihr uns sich auch nur schon mehr sehr diese dieser dieses kaum später".split(),
    "fr": "le la les l un une des du de d et ou mais si que qu qui quoi dont où au aux en dans sur sous avec sans pour par ne n pas plus ce cet cette ces c se s il elle on nous vous ils elles je j y est sont était a ont été être avoir avons avant après car comme encore même personne déjà très lui leur sa son ses".split(),
    "es": "el la los las un una unos unas y o pero si que quien cual de del al a en con sin por para sobre entre desde hasta no ni se su sus lo le les es son era está están fue ha han hay hemos muy más ya como cuando alguien nadie todavía porque antes después este esta estos estas yo tú él ella nosotros qué dos".split(),
    "ja": list("のをにはがもとでへやかてしいるれらこそあ"),
    "zh": list("的了在是有没不这那我们你他她和要会就也已对把被着里中之为什么"),
}
LANGUAGES = list(FUNCTION_WORDS)
NAMES = ["link", "tag", "number", "repeat", "bare", "function", "entropy", "distinct", "lines", "top"]
#: Least robust deviation of each feature, so that one that hardly varies doesn't decide alone.
FLOOR = np.array([0.05, 0.05, 0.05, 0.10, 0.12, 0.08, 0.05, 0.08, 0.04, 0.06])
ALL = "*"  #: the norm over all documents
SHRINK = 50  #: documents that the norm over all counts as in that of a language
LABELS_MOST = 50_000  #: reviewed pages used at most
MADE_UP = 4.0  #: reviewed pages that all made-up ones together count as
CHI2 = 29.6  #: the 0.999 quantile of chi-square with ten degrees of freedom
RIDGE = 0.1

_TOKEN = r"www\.[^\s|]+|{letters}+(?:://[^\s>|]+)?|{signs}+(?:[.,][0-9]+)*|\n|#[^\s#]+|\[\[[^\]\n]*\]\]|\[[^\]\n]*\]\([^)\n]*\)"
TOKEN = _TOKEN.format(letters=r"\p{L}", signs=r"[\p{L}\p{N}]")  #: links, words, numbers, line ends and tags of lower-cased text
LINE_END = r"\r\n?|[\u0085\u2028\u2029]"
_CJK = "぀-ヿ㐀-鿿가-힯"
_PARTICLES = "".join(sorted({w for g in ("ja", "zh") for w in FUNCTION_WORDS[g] if len(w) == 1}))
#: Scripts without spaces: a particle, what stands between particles, or anything else.
_PART = re.compile(rf"[{_PARTICLES}]|[{_CJK}]+?(?=[{_PARTICLES}]|[^{_CJK}]|$)|[^{_CJK}]+")
_TELLS: dict[str, int] = {}
for _n, _g in enumerate(LANGUAGES):
    for _w in FUNCTION_WORDS[_g]:
        _TELLS[_w] = _TELLS.get(_w, 0) | 1 << _n
_END, _LINK, _TAG, _NUMBER, _WORD, _SIGNS = range(6)


def _vocabulary(tokens: list[str]) -> tuple[np.ndarray, ...]:
    """Of each distinct token the parts it falls into (offsets, parts), and of each distinct part kind, languages told, length."""
    known: dict[str, int] = {}
    offsets, parts, kinds, tells, sizes = [0], [], [], [], []
    for t in tokens:
        c = t[0]
        if c == "\n":
            found = ((t, _END),)
        elif c == "#":
            found = ((t, _TAG),)
        elif c == "[" or "://" in t or t.startswith("www."):
            found = ((t, _LINK),)
        elif c < "぀":
            found = ((t, _NUMBER if any(x.isdigit() for x in t) else _WORD),)
        else:
            found = tuple((x, _SIGNS if x[0] >= "぀" else _WORD) for x in _PART.findall(t))
        for x, kind in found:
            at = known.get(x)
            if at is None:
                at = known[x] = len(kinds)
                kinds.append(kind)
                tells.append(_TELLS.get(x, 0) if kind >= _WORD else 0)
                sizes.append(len(x))
            parts.append(at)
        offsets.append(len(parts))
    return np.array(offsets, np.int32), np.array(parts, np.int32), np.array(kinds, np.int8), np.array(tells, np.int32), np.array(sizes, np.int64)


def measure(texts: pa.ListArray) -> tuple[list[str], np.ndarray]:
    """The language that the function words tell (ALL if they tell none) and the features NAMES of texts as lists of TOKEN (no nulls)."""
    n = len(texts)
    coded = texts.flatten().dictionary_encode()
    offsets, parts, kinds, tells, sizes = _vocabulary(coded.dictionary.to_pylist())
    at = texts.offsets.to_numpy() - texts.offsets[0].as_py()
    part = pa.ListArray.from_arrays(offsets, parts).take(coded.indices).flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[coded.indices.to_numpy()])])[at]
    doc = np.repeat(np.arange(n), np.diff(ends))
    kind, told = kinds[part], tells[part]
    word = kind >= _WORD
    line = np.cumsum(kind == _END) + doc
    mass = np.where(kind == _END, 0.0, sizes[part] + 1.0)
    weight = np.where(kind == _SIGNS, np.maximum(1.0, sizes[part] / 2), np.where(kind >= _NUMBER, 1.0, 0.0))
    words = np.bincount(doc, weight, n)

    by_language = np.stack([np.bincount(doc, told >> g & 1, n) for g in range(len(LANGUAGES))], 1)
    best = by_language.argmax(1)
    ja, zh = LANGUAGES.index("ja"), LANGUAGES.index("zh")
    best = np.where((best == ja) | (best == zh), np.where(by_language[:, ja] < 2, zh, ja), best)
    enough = by_language.max(1) >= np.maximum(3, 0.1 * words)
    languages = [LANGUAGES[b] if e else ALL for b, e in zip(best, enough)]

    # The histogram of each text's words.
    counted = np.flatnonzero(kind >= _NUMBER)
    pair, where, count = np.unique(doc[counted].astype(np.int64) * max(len(kinds), 1) + part[counted], return_inverse=True, return_counts=True)
    of, which = np.divmod(pair, max(len(kinds), 1))
    total = np.bincount(of, count, n)
    share = count / np.maximum(total, 1)[of]
    entropy = -np.bincount(of, share * np.log(share), n) / np.log(np.maximum(total, 2))
    content = (tells[which] == 0) & (kinds[which] != _NUMBER)
    often = np.zeros(len(part), bool)
    often[counted] = (content & (count >= np.maximum(3, 0.03 * total[of])))[where]
    again = count * (content & (count >= 2))
    order = np.lexsort((-again, of))
    place = np.arange(len(order)) - np.searchsorted(of[order], np.arange(n))[of[order]]
    top = np.bincount(of[order], again[order] * (place < 6), n) / np.maximum(total, 1)

    lines = int(line[-1]) + 1 if len(line) else 0
    of_line = np.zeros(lines, np.int64)
    of_line[line] = doc
    line_mass, line_words = np.bincount(line, mass, lines), np.maximum(np.bincount(line, weight, lines), 1)
    line_function = np.bincount(line, (told > 0) * weight, lines)
    bare = np.clip(1 - line_function / line_words / 0.12, 0, 1)
    repeated = np.clip((np.bincount(line, often * weight, lines) / line_words - 0.1) / 0.4, 0, 1)
    undescribed = np.clip(1 - line_function / 4, 0, 1)[line]  # beside no sentence
    whole = np.maximum(np.bincount(doc, mass, n), 1)
    return languages, np.stack(
        [
            *(np.bincount(doc, mass * (kind == k) * undescribed, n) / whole for k in (_LINK, _TAG, _NUMBER)),
            np.bincount(of_line, line_mass * repeated, n) / whole,
            np.bincount(of_line, line_mass * bare, n) / whole,
            np.bincount(doc, (told > 0) * weight, n) / np.maximum(words, 1),
            entropy,
            np.bincount(of, minlength=n) / np.maximum(total, 1),
            np.log1p(np.bincount(of_line, line_mass > 0, n)) / np.log1p(whole),
            top,
        ],
        1,
    )


def tokens_of(texts: list[str]) -> pa.ListArray:
    """TOKEN of texts, as the JVM finds them."""
    found = re.compile(_TOKEN.format(letters=r"[^\W\d_]", signs=r"[^\W_]"))
    return pa.array([found.findall(re.sub(LINE_END, "\n", x).lower()) for x in texts], pa.list_(pa.string()))


def made_up_pages() -> tuple[list[str], list[str]]:
    """Pages that consist of nothing but what the definition names (repeated keywords, links without a description, tags, product
    strings), and pages as unusual that are none: records, code, words and numbers by themselves."""
    name, more = "kelvor mandi", "one two red blue new big".split() * 6
    bad = [
        ", ".join(f"{x} {name}" if n % 2 else f"{name} {x}" for n, x in enumerate(more)),
        " ".join([f"Order {name}, compare {name}, and get {name} with {name} today."] * 12),
        "、".join(["商品", "商品購買"] * 20),
        "\n".join(f"https://kelvor{n}.example/a{n}/b{n}" for n in range(24)),
        "\n".join(f"- [here {n}](https://kelvor{n}.example/a{n})" for n in range(24)),
        "\n".join(f"| {name} | https://kelvor{n}.example/a{n} |" for n in range(24)),
        "\n".join(f"[[kelvor {n}]]" for n in range(30)),
        " ".join(f"#kelvor{n}" for n in range(40)),
        "\n".join(f"ab{n}c {name} {10 + n}.99 #item{n % 5}" for n in range(24)),
    ]
    letters = "abcdefghijklmnopqrstuvwx"
    good = [
        "\n".join(f"{n};kel{x}vor;2024-01-{n};{n * 37}.{n}" for n, x in enumerate(letters)),
        "\n".join(f"def kel{x}(man{x}): return vor{x}[{n}]" for n, x in enumerate(letters)),
        "kelvor", "kelvor mandi tal", "12 13 14", "商品", "?!",
    ]
    return bad, good


def page_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, lang (told by the text, else ALL) and the features of every document with a text that isn't blank."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            languages, values = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages), *[pa.array(values[:, i]) for i in range(len(NAMES))]], names=["key", "lang", *NAMES])

    kind = docs.schema[key].dataType.simpleString()
    some = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")), "key").where(F.col("text").rlike(r"\S"))
    found = some.select("key", F.regexp_extract_all(F.lower(F.regexp_replace("text", LINE_END, "\n")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    return found.mapInArrow(run, f"key {kind}, lang string, " + ", ".join(f"{x} double" for x in NAMES))


def robust_model(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and whitening matrix of ALL, over all rows of ``table``, and of each language that some tell, drawn towards ALL as if by SHRINK documents."""
    spark, d = table.sparkSession, len(NAMES)
    table = table.select(F.explode(F.array_distinct(F.array("lang", F.lit(ALL)))).alias("lang"), *NAMES)

    def medians(df: DataFrame, of) -> dict[str, tuple[int, np.ndarray]]:
        rows = df.groupBy("lang").agg(F.array(*[F.percentile_approx(of(x), 0.5, 2000) for x in NAMES]).alias("m"), F.count(F.lit(1)).alias("n")).collect()
        return {r["lang"]: (r["n"], np.array(r["m"])) for r in rows}

    def drawn(found: dict[str, tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
        return {k: v if k == ALL else (n * v + SHRINK * found[ALL][1]) / (n + SHRINK) for k, (n, v) in found.items()}

    def beside(df: DataFrame, values: dict[str, np.ndarray], prefix: str) -> DataFrame:
        # One row a language.
        return df.join(F.broadcast(spark.createDataFrame([(k, *map(float, v)) for k, v in values.items()], "lang string, " + ", ".join(f"{prefix}{x} double" for x in NAMES))), "lang")

    if not (found := medians(table, F.col)):
        return {}
    centres = drawn(found)
    away = beside(table, centres, "m_").select("lang", *[(F.col(x) - F.col(f"m_{x}")).alias(x) for x in NAMES])
    scales = {k: np.maximum(1.4826 * v, FLOOR) for k, v in drawn(medians(away, lambda x: F.abs(F.col(x)))).items()}
    wrapped = beside(away, scales, "s_").select("lang", *[F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col(x) / F.col(f"s_{x}"))).alias(x) for x in NAMES])
    cross = [F.avg(F.col(a) * F.col(b)) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
    scatters = {}
    for r in wrapped.groupBy("lang").agg(F.array(*cross).alias("c"), F.array(*[F.avg(x) for x in NAMES]).alias("a"), F.count(F.lit(1)).alias("n")).collect():
        scatter = np.zeros((d, d))
        scatter[np.tril_indices(d)] = r["c"]
        scatters[r["lang"]] = (r["n"], scatter + np.tril(scatter, -1).T - np.outer(r["a"], r["a"]))
    model = {}
    for g, scatter in drawn(scatters).items():
        scatter = 0.8 * scatter + 0.2 * np.diag(np.maximum(np.diag(scatter), 0.3))
        values, vectors = np.linalg.eigh(scatter)
        whiten = vectors @ np.diag(np.maximum(values, 0.05) ** -0.5) @ vectors.T
        model[g] = (centres[g], whiten / scales[g])
    return model


def whitened(model: dict, languages: list[str], values: np.ndarray) -> np.ndarray:
    """Deviations from the norm of the language; their squared lengths are the squared Mahalanobis distances."""
    out = np.zeros_like(values)
    langs = np.array(languages)
    for g in set(languages):
        (centre, matrix), at = model.get(g) or model[ALL], langs == g
        out[at] = (values[at] - centre) @ matrix.T
    return out


def fit_direction(white: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The spam direction (a unit vector) and the offset along it, by ridge logistic regression, refitted without the labels that contradict it most."""
    x = np.column_stack([white / 10, np.ones(len(white))])
    w, keep = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(4):
        a, y, q = x[keep], target[keep], weight[keep]

        def loss(w: np.ndarray) -> float:
            return float((q * np.logaddexp(0, (1 - 2 * y) * (a @ w))).sum() + RIDGE / 2 * w @ w)

        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (q * p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w))
            step, size = np.linalg.solve(h, a.T @ (q * (y - p)) - RIDGE * w), 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
        keep = np.abs(target - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) < 0.85
    long = np.linalg.norm(w[:-1]) / 10
    return w[:-1] / 10 / long, float(-w[-1] / long)


def spam_direction(model: dict, languages: list[str], values: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Direction and offset from the outliers among reviewed pages, and from made-up ones: whole, spam mixed with a quarter and three quarters of the usual, and the usual."""
    white = whitened(model, languages, values)
    out = (white**2).sum(1) > CHI2
    bad, good = (measure(tokens_of(pages))[1] for pages in made_up_pages())
    mixed = [(matrix @ ((p - centre) * part), float(part > 0.5)) for centre, matrix in model.values() for p in bad for part in (1.0, 0.75, 0.25)]
    mixed += [(matrix @ (p - centre), 0.0) for centre, matrix in model.values() for p in good]
    mixed += [(np.zeros(len(NAMES)), 0.0)] * len(model)
    x = np.vstack([white[out], *[v for v, _ in mixed]])
    y = np.concatenate([target[out], [t for _, t in mixed]])
    return fit_direction(x, y, np.concatenate([np.ones(out.sum()), np.full(len(mixed), MADE_UP / len(mixed))]))


def spam_pages(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, distance, along (the distance in the spam direction) of the pages flagged.

    ``labels`` has the key and ``label``; pages labelled neither ``spam`` nor ``ok``, or both, teach nothing, and without
    labels the made-up pages alone give the direction. Null, empty and blank texts are never flagged; repeated texts are
    judged alike; empty tables give no rows; other columns are ignored. Whole texts are read, of any length.
    """
    table = cut(page_features(docs, key, text))
    model = robust_model(table)
    said = labels.where(F.col("label").isin("spam", "ok")).groupBy(F.col(key).alias("key")).agg(F.avg((F.col("label") == "spam").cast("double")).alias("y")).where("y in (0.0, 1.0)")
    taught = table.join(said, "key").orderBy(F.xxhash64("key")).limit(LABELS_MOST).toPandas()
    values = taught[NAMES].to_numpy(float).reshape(-1, len(NAMES))
    direction, offset = spam_direction(model, taught["lang"].tolist(), values, taught["y"].to_numpy(float)) if model else (np.zeros(len(NAMES)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(x).to_numpy() for x in NAMES])
            white = whitened(model, batch.column("lang").to_pylist(), values)
            distance, along = np.sqrt((white**2).sum(1)), white @ direction
            flag = (distance**2 > CHI2) & (along > offset)
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(flag)), pa.array(distance[flag]), pa.array(along[flag])], names=[key, "distance", "along"])

    kind = docs.schema[key].dataType.simpleString()
    return table.mapInArrow(run, f"`{key}` {kind}, distance double, along double")
