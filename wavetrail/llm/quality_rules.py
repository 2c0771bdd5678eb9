"""Quality rules on text statistics: fixed rules first, then a robust multivariate test inside each language and source.

Five statistics of a text (words, characters a word, and symbols, equal lines, words in repeated windows per hundred words) are brought to
a log scale. For each language and source the minimum covariance determinant is sought by concentration steps: distances from the current
centre and covariance, the nearest three quarters of the documents, their mean and covariance as the next estimate. A text whose squared
Mahalanobis distance from the final estimate is beyond the chi-square quantile is an outlier.

* Statistics are whole multiples of 1/1024, so sums over any number of documents and partitions are exact and reruns agree.
* A step is one aggregation: documents are counted and summed per (group, distance class); the classes nearest to the centre that hold three
  quarters of the group are added up. A group of any size brings at most a few hundred rows, whatever share of all documents it has.
* The start is the coordinate-wise median of the language. Estimates of a source are started from its language's and drawn to it with the
  weight of ``PSEUDO`` documents, so small sources are judged mostly by their language and large ones by themselves, without a switch.
* A least spread per statistic keeps statistics that are zero nearly everywhere from rejecting the first text that has any.

Only DataFrame functions are used; texts are read once, and only the statistics are written and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise

#: The fixed rules.
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Statistics are multiples of 1 / UNIT on the log scale; distance classes are 1 / CLASSES wide on the scale of ln(1 + squared distance).
UNIT, MEDIAN_BIN, CLASSES = 1024, 64, 16
#: Share of a group that the estimate rests on, and the factor that makes its covariance right for normal data (5 statistics).
SHARE, CONSISTENT = 0.75, 1.4120710602
#: Concentration steps for languages and for sources.
STEPS = 4
#: Documents that the language's estimate counts for in that of a source.
PSEUDO = 50
#: Copies of a group's factors in the join with its documents.
SALTS = 64
#: Least spread of each statistic: words, characters a word, symbols, equal lines, repeated words.
SPREAD = (1.0, 0.15, 0.6, 0.7, 0.7)
#: Quantile 0.9999 of chi-square with 5 degrees of freedom.
CUTOFF = 25.744831959067
#: Stands for null in the group keys.
NO_KEY = "\x00"

_DIMS = range(len(SPREAD))
_PAIRS = [(i, j) for i in _DIMS for j in range(i + 1)]
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _at_log(top: str, factor: int, below: str) -> str:
    return f"CAST(round({UNIT} * ln(1 + {factor} * CAST({top} AS DOUBLE) / greatest({below}, 1))) AS BIGINT)"


#: Portable SQL, used by the query and by its oracle: statistics, rules, factor of the covariance, distance.
_FEATURES = [
    f"CAST(round({UNIT} * ln(1 + CAST(n_words AS DOUBLE))) AS BIGINT) AS x0",
    f"{_at_log('word_chars', 1, 'n_words')} AS x1",
    f"{_at_log('n_symbols', 100, 'n_words')} AS x2",
    f"{_at_log('n_dup_lines', 100, 'n_words')} AS x3",
    f"{_at_log('n_repeat_words', 100, 'n_words')} AS x4",
]
_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words)"
_SUMS = [f"sum(x{i}) AS s{i}" for i in _DIMS] + [f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in _PAIRS]
_ADDED = ["sum(n) AS n"] + [f"sum(s{i}) AS s{i}" for i in _DIMS] + [f"sum(q{i}{j}) AS q{i}{j}" for i, j in _PAIRS]
_MOMENTS = [f"CAST(s{i} AS DOUBLE) / n AS e{i}" for i in _DIMS] + [
    f"CAST(q{i}{j} AS DOUBLE) / n - CAST(s{i} AS DOUBLE) / n * (CAST(s{j} AS DOUBLE) / n) AS v{i}{j}" for i, j in _PAIRS
]


def _factor(centre: list[str], cov: dict[tuple[int, int], str]) -> list[list[str]]:
    """Levels of columns: centre m and lower triangular factor l of the covariance, each level built on those before it."""
    levels = [[f"{c} AS m{i}" for i, c in enumerate(centre)] + [f"{cov[p]} AS c{p[0]}{p[1]}" for p in _PAIRS]]
    for j in _DIMS:
        done = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        levels.append([f"sqrt(c{j}{j}{done}) AS l{j}{j}"])
        below = [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(SPREAD))]
        if below:
            levels.append(below)
    return levels


def _spread(i: int, j: int) -> str:
    return f" + {float((UNIT * SPREAD[i]) ** 2)!r}" if i == j else ""


_FACTORS = [f"m{i}" for i in _DIMS] + [f"l{i}{j}" for i, j in _PAIRS]
_START = _factor([f"CAST(h{i} AS DOUBLE)" for i in _DIMS], {(i, j): f"CAST(0 AS DOUBLE){_spread(i, j)}" for i, j in _PAIRS})
_OWN = _factor([f"e{i}" for i in _DIMS], {(i, j): f"{CONSISTENT} * v{i}{j}{_spread(i, j)}" for i, j in _PAIRS})
_DRAWN = _factor(
    [f"(n * e{i} + {PSEUDO} * p{i}) / (n + {PSEUDO})" for i in _DIMS],
    {(i, j): f"{CONSISTENT} * (n * v{i}{j} + {PSEUDO} * w{i}{j}) / (n + {PSEUDO}){_spread(i, j)}" for i, j in _PAIRS},
)
#: Forward substitution, one level for each statistic, then the squared distance.
_DISTANCE = [[f"(x{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}"] for i in _DIMS] + [
    [" + ".join(f"y{i} * y{i}" for i in _DIMS) + " AS distance"]
]
_CLASS = f"CAST(floor({CLASSES} * ln(1 + distance)) AS BIGINT)"


def _levels(df: DataFrame, levels: list[list[str]]) -> DataFrame:
    for level in levels:
        df = df.selectExpr("*", *level)
    return df


def _repeated_words(words: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows of ``WINDOW`` words that the text holds twice or more. Needs `words`."""
    window = F.expr(f"transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({', '.join(f'words[i + {k}]' for k in range(WINDOW))}))")
    hashed = words.withColumn("windows", F.when(F.size("words") > WINDOW, window).otherwise(F.expr("array(0L)")))
    # most texts repeat no window; the others are sorted, so that equal windows are neighbours
    listed = hashed.withColumn("ordered", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h, i))) END"))
    twice = "filter(ordered, (w, k) -> (k > 0 AND get(ordered, k - 1).h = w.h) OR coalesce(get(ordered, k + 1).h = w.h, false))"
    placed = listed.withColumn("starts", F.expr(f"sort_array(transform({twice}, w -> w.i))"))
    covered = f"aggregate(starts, struct({-WINDOW} AS last, 0L AS total), (a, s) -> struct(s AS last, a.total + least({WINDOW}, s - a.last) AS total), a -> a.total)"
    return placed.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("windows", "ordered", "starts")


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang_key, source_key, the base counts, base_failed and the statistics x0 to x4 of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(NO_KEY)).alias(f"{name}_key")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key("lang"), key("source"), text.alias("text"))
    without = lambda marks: F.length("text") - F.length(F.translate("text", marks, ""))
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))
    counted = rows.select(
        "doc_id", "lang_key", "source_key",
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        (F.length("text") - without(SPACES)).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    sized = counted.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    )
    base = _repeated_words(sized).select("doc_id", "lang_key", "source_key", *_BASE)
    return base.selectExpr("*", f"{_FAILED} AS base_failed", *_FEATURES)


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """h0 to h4: the class that holds the middle document, by its middle."""
    cells = rows.selectExpr(*keys, f"stack({len(SPREAD)}, {', '.join(f'{i}, x{i}' for i in _DIMS)}) AS (dim, x)")
    cells = cells.groupBy(*keys, "dim", F.floor(F.col("x") / MEDIAN_BIN).alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys, "dim")
    upto = F.sum("n").over(whole.orderBy("bin"))
    middle = cells.withColumn("upto", upto).withColumn("total", F.sum("n").over(whole)).filter("2 * upto >= total")
    found = middle.groupBy(*keys, "dim").agg((F.min("bin") * MEDIAN_BIN + MEDIAN_BIN // 2).alias("h"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("dim") == i, F.col("h"))).alias(f"h{i}") for i in _DIMS])


def _measured(rows: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their squared distance.

    Factors are few, and Spark broadcasts them by their size. Where groups are too many for that, the rows of a group meet copies of its
    factors in ``SALTS`` tasks, so a hot group is not one task's.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars", "x0"), F.lit(SALTS)).cast("int"))
    copies = factors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return _levels(salted.join(copies, [*keys, "salt"]), _DISTANCE).drop("salt", *_FACTORS, *[f"y{i}" for i in _DIMS])


def _concentrate(rows: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Number, mean e and covariance v of the nearest documents of each group."""
    cells = _measured(rows, factors, keys).withColumn("class", F.expr(_CLASS)).groupBy(*keys, "class")
    cells = cells.agg(F.count("*").alias("n"), *map(F.expr, _SUMS))
    group = Window.partitionBy(*keys)
    nearer = F.sum("n").over(group.orderBy("class")) - F.col("n")
    nearest = cells.withColumn("nearer", nearer).withColumn("total", F.sum("n").over(group)).filter(F.col("nearer") < SHARE * F.col("total"))
    return nearest.groupBy(*keys).agg(*map(F.expr, _ADDED)).selectExpr(*keys, "n", *_MOMENTS)


def fit(rows: DataFrame) -> DataFrame:
    """Centre m and covariance factor l of each (lang_key, source_key), from all rows given."""
    language, group = ["lang_key"], ["lang_key", "source_key"]
    factors = materialise(_levels(_medians(rows, language), _START).select(*language, *_FACTORS), "quality-start")
    for step in range(STEPS):
        moments = materialise(_concentrate(rows, factors, language), f"quality-language-{step}")
        factors = _levels(moments, _OWN).select(*language, *_FACTORS)
    prior = moments.select(*language, *[F.col(f"e{i}").alias(f"p{i}") for i in _DIMS], *[F.col(f"v{i}{j}").alias(f"w{i}{j}") for i, j in _PAIRS])
    own = materialise(rows.select(*group).distinct().join(factors, language), "quality-sources")
    for step in range(STEPS):
        moments = materialise(_concentrate(rows, own, group), f"quality-source-{step}")
        own = _levels(moments.join(prior, language), _DRAWN).select(*group, *_FACTORS)
    return own


def judge(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, squared distance, kept.

    documents: doc_id, text, lang, source; other columns are ignored. A null text is empty (and fails); null languages and sources are
    groups of their own; estimates rest on all documents that pass the fixed rules, and those are judged; distance is null for the others.
    A group's only document is judged by its language, a language's only document is its own centre and stays. Repeated rows count each;
    no rows give no rows.
    """
    rows = materialise(statistics(documents), "quality-statistics")
    passed = rows.filter("NOT base_failed")
    factors = materialise(fit(passed), "quality-factors")
    judged = _measured(passed, factors, ["lang_key", "source_key"]).withColumn("kept", F.col("distance") <= CUTOFF)
    failed = rows.filter("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return judged.unionByName(failed).select("doc_id", *_BASE, "base_failed", "distance", "kept")


def _select_levels(source: str, levels: list[list[str]]) -> str:
    for level in levels:
        source = f"(SELECT *, {', '.join(level)} FROM {source})"
    return source


def _step_sql(name: str, before: str, keys: str) -> str:
    measured = _select_levels(f"(SELECT f.*, {', '.join(f'p.{c}' for c in _FACTORS)} FROM passed f JOIN {before} p USING ({keys}))", _DISTANCE)
    return f"""{name}_cells AS MATERIALIZED (SELECT {keys}, {_CLASS} AS class, count(*) AS n, {', '.join(_SUMS)} FROM {measured} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, n, {', '.join(_MOMENTS)} FROM (SELECT {keys}, {', '.join(_ADDED)} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY class) - n AS nearer, sum(n) OVER (PARTITION BY {keys}) AS total FROM {name}_cells
) WHERE nearer < {SHARE} * total GROUP BY ALL))"""


def _sql() -> str:
    parts = [
        "t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') || CASE WHEN lang IS NULL THEN chr(1) ELSE '' END AS lang_key, coalesce(source, '') || CASE WHEN source IS NULL THEN chr(1) ELSE '' END AS source_key, coalesce(text, '') AS text FROM documents)",
        "w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t)",
        f"g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w))",
        f"c AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS place FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1) GROUP BY r)",
        "base AS MATERIALIZED (SELECT w.*, CAST(len(words) AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars, "
        f"length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r))",
        f"stats AS MATERIALIZED (SELECT r, doc_id, lang_key, source_key, {', '.join(_BASE)}, {_FAILED} AS base_failed, {', '.join(_FEATURES)} FROM base)",
        "passed AS MATERIALIZED (SELECT * FROM stats WHERE NOT base_failed)",
    ]
    medians = [
        f"CAST((SELECT min(bin) FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM (SELECT x{i} // {MEDIAN_BIN} AS bin, count(*) AS n FROM passed q WHERE q.lang_key = k.lang_key GROUP BY 1)) WHERE 2 * upto >= total) * {MEDIAN_BIN} + {MEDIAN_BIN // 2} AS BIGINT) AS h{i}"
        for i in _DIMS
    ]
    parts.append(f"start AS MATERIALIZED (SELECT * FROM {_select_levels('(SELECT lang_key, ' + ', '.join(medians) + ' FROM (SELECT DISTINCT lang_key FROM passed) k)', _START)})")
    before = "start"
    for step in range(STEPS):
        parts += [_step_sql(f"lang{step}", before, "lang_key"), f"lang{step}_f AS MATERIALIZED (SELECT * FROM {_select_levels(f'lang{step}', _OWN)})"]
        before = f"lang{step}_f"
    parts.append(
        f"prior AS (SELECT lang_key, {', '.join(f'e{i} AS p{i}' for i in _DIMS)}, {', '.join(f'v{i}{j} AS w{i}{j}' for i, j in _PAIRS)} FROM lang{STEPS - 1})"
    )
    parts.append(f"sources AS MATERIALIZED (SELECT k.source_key, p.* FROM (SELECT DISTINCT lang_key, source_key FROM passed) k JOIN {before} p USING (lang_key))")
    before = "sources"
    for step in range(STEPS):
        drawn = _select_levels(f"(SELECT g.*, p.* EXCLUDE (lang_key) FROM source{step} g JOIN prior p USING (lang_key))", _DRAWN)
        parts += [_step_sql(f"source{step}", before, "lang_key, source_key"), f"source{step}_f AS MATERIALIZED (SELECT * FROM {drawn})"]
        before = f"source{step}_f"
    measured = _select_levels(f"(SELECT f.*, {', '.join(f'p.{c}' for c in _FACTORS)} FROM passed f JOIN {before} p USING (lang_key, source_key))", _DISTANCE)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, {", ".join(_BASE)}, base_failed, coalesce(distance <= {CUTOFF}, false) AS kept FROM stats LEFT JOIN (SELECT r, distance FROM {measured}) USING (r)"""


@query("op12_quality_rules", _sql())
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("distance")
