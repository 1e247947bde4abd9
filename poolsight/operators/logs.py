"""Log and receipt mining (family D)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from poolsight.functions import order as O
from poolsight.functions import text as T
from poolsight.sources import schemas, workspace


def result_line_kv(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row per key=value of each RESULT line; quotes around a value are removed."""
    pairs = lines.withColumn("_pair", F.explode(T.result_pairs(F.col(line)))).drop(line)
    return pairs.select(
        *[c for c in pairs.columns if c != "_pair"],
        F.col("_pair.key").alias("key"),
        F.regexp_replace("_pair.value", "^'|'$", "").alias("value"),
    )


def sentinel_presence(lines: DataFrame, sentinels: Sequence[str], by: str = "run", line: str = "line") -> DataFrame:
    """Which sentinels occur in which log, with line counts; absent pairs give no row."""
    hits = lines.select(by, F.explode(T.present_sentinels(F.col(line), sentinels)).alias("sentinel"))
    return hits.groupBy(by, "sentinel").agg(F.count(F.lit(1)).alias("lines"))


#: Characters of a gram, of the pieces a text is cut into, and of the bits a piece is cut into.
GRAM, PIECE, BIT = 3, 1 << 16, 256
#: Beyond so many patterns the join with them is shuffled, whatever their size on disk.
BROADCAST_PATTERNS = 1 << 16


def pattern_hits(texts: DataFrame, patterns: DataFrame, id: str = "id", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Which of many literal patterns occur in which text: distinct (id, pattern), however many patterns there are.

    A text that holds a pattern holds its grams of three characters at their places in it. Each pattern is looked up by
    one gram. Where that gram stands in a text, one window is cut for each shape (place of the gram, length) that
    patterns of the gram have, and joined with the patterns as a whole: thousands of patterns of one shape cost one
    window. Of a pattern's grams that one is taken which, by its number in all texts, makes the fewest windows for each
    pattern that has it. A pattern of one or two characters is its own gram.

    `id` is unique in `texts`; a null one matches nothing. Null texts and null or empty patterns match nothing; repeated
    patterns count once. Patterns and texts compare character by character, with no change of case.
    """
    asked = patterns.select(F.col(pattern).alias("__pattern")).filter(F.length("__pattern") > 0).distinct()
    size = F.length("__pattern")
    short = F.least(size, F.lit(GRAM))
    # lengths of grams that patterns have, one to three, and the longest pattern
    found = {row[0]: row[1] for row in asked.groupBy(short).agg(F.max(size)).collect()}
    whole = texts.select(F.col(id).alias("__id"), F.col(text).alias("__text")).filter((F.length("__text") > 0) & F.col("__id").isNotNull())
    if not found:
        return whole.select(F.col("__id").alias(id), F.col("__text").alias(pattern)).filter(F.lit(False))
    reach, sizes = max(found.values()), sorted(found)
    places = asked.select("__pattern", size.alias("__size"), F.explode(F.sequence(F.lit(0), size - short)).alias("__place"))
    gram = F.col("__pattern").substr(F.col("__place") + 1, F.least("__size", F.lit(GRAM))).alias("__gram")
    # what is written has a known size: it is broadcast while it is small, so grams that no pattern has go where texts are read
    of_pattern = workspace.materialise(places.select("__pattern", "__size", "__place", gram), "pattern-places")
    of_shape = of_pattern.groupBy("__gram", "__place", "__size").agg(F.count(F.lit(1)).alias("__n"))
    of_gram = of_shape.groupBy("__gram").agg(F.count(F.lit(1)).alias("__shapes"), F.sum("__n").alias("__patterns"))
    of_gram = workspace.materialise(of_gram, "pattern-grams")
    met = _places(whole.select("__text"), sizes, 0).join(of_gram.select("__gram"), "__gram", "left_semi")
    counts = met.groupBy("__gram").agg(F.count(F.lit(1)).alias("__met"))
    price = F.col("__met") * F.col("__shapes") / F.col("__patterns")
    prices = workspace.materialise(of_gram.join(counts, "__gram").select("__gram", price.alias("__price")), "gram-prices")
    # a pattern with a gram that never occurs has that gram at no price, and no text meets it
    cheapest = F.min(F.struct(F.coalesce("__price", F.lit(0.0)).alias("price"), "__gram", "__place")).alias("x")
    index = of_pattern.join(prices, "__gram", "left").groupBy("__pattern", "__size").agg(cheapest)
    index = workspace.materialise(index.filter("x.price > 0").select("__pattern", "__size", "x.__gram", "x.__place"), "pattern-index")
    shapes = workspace.materialise(index.select("__gram", "__place", "__size").distinct(), "pattern-shapes")
    begin, row = F.col("__at") - F.col("__place"), F.monotonically_increasing_id().alias("__row")
    windows = _places(whole.select("__id", row, "__text"), sizes, reach).join(shapes, "__gram").filter(
        (begin > 0) & (begin + F.col("__size") - 1 <= F.length("__text"))
    ).select("__id", "__row", F.col("__text").substr(begin, F.col("__size")).alias("__pattern"))
    known = index.select("__pattern")
    if index.count() > BROADCAST_PATTERNS:
        known = known.hint("merge")
    return windows.join(known, "__pattern").distinct().select(F.col("__id").alias(id), F.col("__pattern").alias(pattern))


def _places(texts: DataFrame, sizes: Sequence[int], reach: int) -> DataFrame:
    """A row for each place `__at` of a text and the gram there, of each size; `__text` is cut to a bit of the text, with
    at least `reach` characters on both sides of the place where the text has them."""
    reach = max(reach, GRAM)
    kept = [c for c in texts.columns if c != "__text"]
    bits = texts.select("*", F.lit(1).alias("__first"), F.length("__text").alias("__own"))
    for step in (max(PIECE, reach), max(BIT, reach)):
        # a place in a long text costs the characters before it, so pieces are cut first and bits from them
        cut = bits.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__own") - 1, F.lit(step))))
        start, own = F.col("__first") + F.col("__k"), F.least(F.col("__own") - F.col("__k"), F.lit(step))
        lead = F.least(start - 1, F.lit(reach))
        bits = cut.select(*kept, F.col("__text").substr(start - lead, lead + own + reach).alias("__text"), (lead + 1).alias("__first"), own.alias("__own"))
    at = bits.withColumn("__at", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__own") - 1)))
    grams = [F.when(F.col("__at") + (size - 1) <= F.length("__text"), F.col("__text").substr(F.col("__at"), F.lit(size))) for size in sizes]
    if len(grams) == 1:
        return at.select(*kept, "__text", "__at", grams[0].alias("__gram")).filter(F.col("__gram").isNotNull())
    return at.select(*kept, "__text", "__at", F.explode(F.array(*grams)).alias("__gram")).filter(F.col("__gram").isNotNull())


def launcher_parse(lines: DataFrame) -> DataFrame:
    """Split `timestamp - LEVEL - message`; other lines keep nulls."""
    matched = F.col("line").rlike(T.LAUNCHER_PATTERN)

    def part(i: int) -> Column:
        return F.when(matched, F.regexp_extract("line", T.LAUNCHER_PATTERN, i))

    return lines.select(
        *[c for c in lines.columns if c != "line"],
        part(1).try_cast("timestamp_ntz").alias("logged_at"),
        part(2).alias("level"),
        part(3).alias("message"),
    )


def correlation_ids(parsed: DataFrame, by: str = "file", keys: Sequence[str] = T.CORRELATION_KEYS) -> DataFrame:
    """The launcher's id block as one row per log; fixed keys, so a plain aggregate replaces a pivot."""
    key = F.regexp_extract("message", T.CORRELATION_PATTERN, 1)
    value = F.regexp_extract("message", T.CORRELATION_PATTERN, 2)
    pairs = parsed.filter(F.col("message").rlike(T.CORRELATION_PATTERN)).select(
        by, key.alias("k"), value.alias("v")
    )
    return pairs.groupBy(by).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in keys])


def phase_duration(parsed: DataFrame, by: str = "file") -> DataFrame:
    """Seconds from the first start marker to the exit line, and the exit code."""
    message, at = F.col("message"), F.col("logged_at")
    code = F.nullif(F.regexp_extract(message, T.EXIT_CODE_PATTERN, 1), F.lit(""))
    spans = parsed.groupBy(by).agg(
        F.min(F.when(message.contains(T.START_MARKER), at)).alias("started_at"),
        F.min(F.when(message.contains(T.USER_CODE_MARKER), at)).alias("user_code_at"),
        F.max(F.when(code.isNotNull(), at)).alias("exited_at"),
        F.max(code.try_cast("int")).alias("exit_code"),
    )
    return spans.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started_at"), F.col("exited_at")))


def json_results(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Explode check payloads; an unreadable one becomes a failed `_output` probe."""
    parsed = payloads.withColumn("_p", F.from_json(F.col(text), schemas.CHECK_PAYLOAD))
    broken = F.map_from_arrays(
        F.array(F.lit("_output")),
        F.array(F.struct(F.lit(False).alias("ok"), F.lit("unreadable payload").alias("detail"))),
    )
    results = F.coalesce(F.col("_p.results"), broken)
    kept = [c for c in payloads.columns if c != text]
    return parsed.select(*kept, F.explode(results).alias("probe", "_r")).select(
        *kept, "probe", F.col("_r.ok").alias("ok"), F.col("_r.detail").alias("detail")
    )


def melt_metrics(wide: DataFrame, dataset: str, metrics: Sequence[str]) -> DataFrame:
    """Wide bench rows to `dataset.metric` rows; text, null and NaN values are skipped."""
    numeric = [c for c in metrics if isinstance(wide.schema[c].dataType, NumericType)]
    tall = wide.select(dataset, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [dataset], numeric, "metric", "value"
    )
    return tall.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        F.concat_ws(".", F.col(dataset).cast("string"), F.col("metric")).alias("key"), "value"
    )


def sanitise_params(params: DataFrame) -> DataFrame:
    """Legal keys and clipped values; on a key clash the last value written (unique `seq`) is kept.

    The last place is found on numbers, in the hash path; text is fetched for the winners only.
    """
    clean = params.select("run", T.clean_key(F.col("key")).alias("key"), "seq")
    last = clean.groupBy("run", "key").agg(F.max("seq").alias("seq"))
    value = F.substring("value", 1, T.PARAM_CHARS).alias("value")
    texts = params.select(F.col("run").alias("_run"), T.clean_key(F.col("key")).alias("_key"), F.col("seq").alias("_seq"), value)
    return last.join(
        texts, F.col("run").eqNullSafe(F.col("_run")) & (F.col("key") == F.col("_key")) & (F.col("seq") == F.col("_seq"))
    ).select("run", "key", "value")


def sanitise_metrics(metrics: DataFrame) -> DataFrame:
    """Legal keys; only numbers count, booleans do not. Input value is (kind, text)."""
    return metrics.filter(F.col("kind").isin("int", "float")).select(
        "run", T.clean_key(F.col("key")).alias("key"), F.col("value").try_cast("double").alias("value"), "step"
    )


def first_receipts(receipts: DataFrame) -> DataFrame:
    """The first receipt (by time, then unique id) of each job run, with all its columns.

    Its place is found on numbers, so a hot run combines map-side; a join then fetches the row.
    """
    place = O.major_minor(O.micros(F.col("logged_at")), F.col("receipt_id"))
    first = receipts.groupBy(F.col("job_run_id").alias("_run")).agg(F.min(place).alias("_place"))
    found = receipts.join(first, (F.col("job_run_id") == F.col("_run")) & (place == F.col("_place")))
    return found.drop("_run", "_place")


def receipt_lookup(runs: DataFrame, receipts: DataFrame, required: bool = False) -> DataFrame:
    """Each run with its first receipt; with `required`, a run without one fails the query."""
    found = runs.join(first_receipts(receipts).drop("logged_at"), "job_run_id", "left")
    if not required:
        return found
    message = F.concat(F.lit("no receipt tagged with job run "), F.col("job_run_id").cast("string"))
    checked = F.when(F.col("receipt_id").isNull(), F.raise_error(message).cast("bigint")).otherwise(
        F.col("receipt_id")
    )
    return found.withColumn("receipt_id", checked)


def metric_history_latest(history: DataFrame) -> DataFrame:
    """Points and latest value of each metric."""
    return history.groupBy("run", "key").agg(
        F.count(F.lit(1)).alias("points"),
        F.max("step").alias("last_step"),
        F.max_by("value", O.major_minor(F.col("step"), O.micros(F.col("ts")))).alias("latest"),
    )


# Fixed value: characters kept of an artifact error.
ERROR_CHARS = 250


def archive_runs(
    params: DataFrame,
    metrics: DataFrame,
    tags: DataFrame,
    artifacts: DataFrame,
    runs: DataFrame,
    provenance: Mapping[str, str],
    errors: DataFrame | None = None,
    client_logs: DataFrame | None = None,
) -> DataFrame:
    """Copy receipts as one long table (run, kind, key, value, step, ts) plus provenance tags.

    A run whose artifacts could not be read (`errors`: run, message) carries the clipped message as a
    tag, and a run without any artifact says so; neither is a failure. `client_logs` (run, path) are
    kept as artifacts of their own folder. Where `runs` has a `status`, it is kept as the final one.
    """

    def rows(df: DataFrame, kind: str, value: Column, step: Column, ts: Column) -> DataFrame:
        return df.select(
            "run", F.lit(kind).alias("kind"), "key", value.cast("string").alias("value"),
            step.cast("bigint").alias("step"), ts.cast("timestamp_ntz").alias("ts"),
        )

    none = F.lit(None)
    stamps = {"archive.source_run_id": F.col("run").cast("string")}
    stamps.update({f"archive.{k}": F.lit(v) for k, v in provenance.items()})
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in stamps.items()])
    stamped = runs.select("run", F.explode(entries).alias("e")).select("run", "e.key", "e.value")
    overridden = tags.filter(~F.col("key").isin(*stamps))
    bare = runs.select("run").join(artifacts.select("run").distinct(), "run", "left_anti")
    message = F.lit("no artifacts")
    if errors is not None:
        told = errors.select("run", F.substring("message", 1, ERROR_CHARS).alias("message"))
        bare, message = bare.join(told, "run", "left"), F.coalesce("message", message)
    bare = bare.select("run", F.lit("archive.artifacts_error").alias("key"), message.alias("value"))
    value = F.col("value")
    copied = rows(params, "param", value, none, none)
    copied = copied.unionByName(rows(metrics, "metric", value, F.col("step"), F.col("ts")))
    for df in (overridden, stamped, bare):
        copied = copied.unionByName(rows(df, "tag", value, none, none))
    named = artifacts.select("run", F.col("path").alias("key"), F.col("path").alias("value"))
    if client_logs is not None:
        name = F.concat(F.lit("client_logs/"), F.substring_index("path", "/", -1))
        named = named.unionByName(client_logs.select("run", name.alias("key"), F.col("path").alias("value")))
    if "status" in runs.columns:
        status = runs.select("run", F.lit("status").alias("key"), F.col("status").alias("value"))
        copied = copied.unionByName(rows(status, "status", value, none, none))
    return copied.unionByName(rows(named, "artifact", value, none, none))
