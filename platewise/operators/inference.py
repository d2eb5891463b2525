"""Batch inference with a user's function, prompts, caching and answer parsing."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.schemas import PROMPT_CACHE
from platewise.session import spread

Model = Callable[[Sequence[str]], Sequence[str]]
ATTEMPTS = 3
BATCH_SIZE = 256
TTL_SECONDS = 7200
FENCE_CHARACTERS = "`json"
EMPTY_LIST = r"^\s*\[\s*\]\s*$"
PARSE_FAILURE = "LLM JSON parsing failed"  # fixed value: name of the fallback row


def llm_batch(
    prompts: DataFrame,
    models: Mapping[str, Callable[[], Model]],
    model: str,
    column: str = "prompt",
    attempts: int = ATTEMPTS,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Prompt column to completion column through the named model.

    ``models`` maps a name to a factory, called once per partition, that returns
    a function from a batch of at most ``batch_size`` prompts to its completions.
    A batch that fails ``attempts`` times is retried prompt by prompt; a prompt
    that still fails gets a null completion and its error instead of failing the
    job. The other columns pass through untouched.
    """
    factory = models[model]
    schema = T.StructType(
        list(prompts.schema.fields) + [T.StructField("completion", T.StringType()), T.StructField("error", T.StringType())]
    )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                texts = batch.column(column).to_pylist()
                answers, error = _attempt(call, texts, attempts)
                if error is None:
                    results = [(a, None) for a in answers]
                else:
                    results = []
                    for one in texts:
                        answer, failure = _attempt(call, [one], attempts)
                        results.append((None, failure) if failure else (answer[0], None))
                made = [pa.array([r[i] for r in results], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "completion", "error"])

    return prompts.mapInArrow(complete, schema)


def _attempt(call: Model, texts: Sequence[str], attempts: int) -> tuple[Sequence[str], str | None]:
    error = "no attempt"
    for _ in range(attempts):
        try:
            answers = list(call(texts))
            if len(answers) == len(texts):
                return answers, None
            error = "answer count differs from prompt count"
        except Exception as e:  # the user's function may raise anything
            error = f"{type(e).__name__}: {e}"
    return [], error


def prompt_key(column: str = "prompt") -> Column:
    return F.md5(F.col(column))


def fresh_cache(cache: DataFrame, now: dt.datetime, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """One stored answer per prompt key, the latest younger than the time to live."""
    young = cache.filter(F.col("created_at") > F.lit(now - dt.timedelta(seconds=ttl_seconds)))
    return young.groupBy("prompt_md5").agg(F.max_by("response", F.struct("created_at", "response")).alias("response"))


def prompt_cache(
    prompts: DataFrame,
    cache: DataFrame,
    now: dt.datetime,
    models: Mapping[str, Callable[[], Model]],
    model: str,
    ttl_seconds: int = TTL_SECONDS,
    column: str = "prompt",
) -> DataFrame:
    """Answers for all prompts: ``response``, ``cache_hit`` and the ``error`` of prompts that failed.

    Only prompts without a fresh answer go to the model, each distinct prompt
    once however often it occurs. Evaluating the result again calls the model
    again; :func:`answer_with_cache` does not.
    """
    keyed = prompts.withColumn("prompt_md5", prompt_key(column))
    fresh = fresh_cache(cache, now, ttl_seconds)
    known = fresh.select("prompt_md5", "response", F.lit(True).alias("cache_hit"), F.lit(None).cast("string").alias("error"))
    answered = _answers(keyed, fresh, models, model, column).withColumn("cache_hit", F.lit(False))
    return keyed.join(known.unionByName(answered), "prompt_md5", "left")


def _answers(
    keyed: DataFrame, fresh: DataFrame, models: Mapping[str, Callable[[], Model]], model: str, column: str
) -> DataFrame:
    """prompt_md5, response and error of each distinct prompt that has no fresh answer."""
    missing = keyed.select("prompt_md5", column).dropDuplicates(["prompt_md5"]).join(fresh, "prompt_md5", "left_anti")
    return llm_batch(missing, models, model, column).select("prompt_md5", F.col("completion").alias("response"), "error")


def _joined(line: str, order: str) -> Column:
    return F.expr(f"listagg({line}, '\n') WITHIN GROUP (ORDER BY {order})")


def _fill(template: str, **blocks: Column) -> Column:
    """Template with every ``{name}`` replaced; a missing block leaves nothing behind."""
    text = F.lit(template)
    for name, block in blocks.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(block, F.lit("")))
    return text


def render_prompt(
    template: str,
    vendor: DataFrame,
    history: DataFrame,
    schedules_by_day: DataFrame,
    holidays: DataFrame,
    places: DataFrame,
) -> DataFrame:
    """One prompt per vendor from a template with {history}, {schedule}, {holidays} and {location}.

    History is one line per day of the window, the schedule one per weekday and
    the calendar one per holiday, so the joined text is bounded.
    """
    past = history.groupBy("vendor_id").agg(
        _joined("concat(cast(created_date AS string), ': ', cast(order_count AS string))", "created_date").alias("history")
    )
    week = schedules_by_day.groupBy("vendor_id").agg(
        _joined("concat(day_of_week, ': ', cast(schedules AS string))", "day_order").alias("schedule")
    )
    calendar = holidays.agg(
        _joined("concat_ws(', ', cast(date AS string), holiday, region, cast(weightage AS string))", "struct(date, holiday)")
    ).scalar()
    filled = _fill(
        template,
        history=F.col("history"),
        schedule=F.col("schedule"),
        holidays=calendar,
        location=F.col("location_text"),
    )
    return (
        vendor.select(F.col("id").alias("vendor_id"))
        .join(past, "vendor_id", "left")
        .join(week, "vendor_id", "left")
        .join(places.select("vendor_id", "location_text"), "vendor_id", "left")
        .select("vendor_id", filled.alias("prompt"))
    )


def render_feedback(template: str, comments: DataFrame, part_size: int = 200) -> DataFrame:
    """Prompts per vendor and item from a template with {reviews}.

    An item with many reviews gets several prompts of about ``part_size``
    reviews each, so that no prompt or group is unbounded and no review is lost.
    """
    item = ["vendor_id", "order_items"]
    parts = comments.groupBy(*item).agg(F.ceil(F.count("*") / part_size).alias("parts"))
    return (
        comments.join(parts, item)
        .withColumn("part", spread(F.col("review_id"), F.col("parts")))
        .groupBy(*item, "part")
        .agg(_joined("concat_ws(', ', rating, user_comment)", "struct(comment_date, review_id)").alias("reviews"))
        .select(*item, "part", _fill(template, reviews=F.col("reviews")).alias("prompt"))
    )


def parse_structured(answers: DataFrame, schema: str, required: Sequence[str], column: str = "response") -> DataFrame:
    """Answer text as a typed struct; ``valid`` is false where it or a required field is missing."""
    parsed = answers.withColumn("parsed", F.from_json(column, schema))
    valid = F.col("parsed").isNotNull()
    for field in required:
        valid = valid & F.col(f"parsed.{field}").isNotNull()
    return parsed.withColumn("valid", valid)


def parse_fenced_json(answers: DataFrame, schema: str, column: str = "response") -> DataFrame:
    """A fenced JSON list as rows (id, name); one row with id -1 where it cannot be read, none for an empty list.

    The fence is stripped as characters, not as a prefix. The text is read as
    JSON first, and with single quotes turned into double quotes if that fails,
    so that names with apostrophes survive.
    """
    bare = F.trim(F.col(column), F.lit(FENCE_CHARACTERS))
    read = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    listed = lambda c: F.coalesce(F.get_json_object(c, "$[0]"), F.lit("")).startswith("{") | c.rlike(EMPTY_LIST)
    usable = lambda c: F.when(listed(c), read(c))
    items = F.coalesce(usable(bare), usable(F.replace(bare, F.lit("'"), F.lit('"'))))
    fallback = F.array(F.struct(F.lit("-1").alias("id"), F.lit(PARSE_FAILURE).alias("name")))
    fields = F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["name"].alias("name")))
    return answers.withColumn("item", F.explode(F.coalesce(fields, fallback))).select(
        *answers.columns, F.col("item.id").alias("item_id"), F.col("item.name").alias("item_name")
    )


def parse_rating(answer: Column) -> Column:
    """Whole number 1–10, else null."""
    number = F.trim(answer).try_cast("int")
    return F.when(number.between(1, 10), number)


def answer_with_cache(
    prompts: DataFrame,
    cache_path: str,
    now: dt.datetime,
    models: Mapping[str, Callable[[], Model]],
    model: str,
    ttl_seconds: int = TTL_SECONDS,
    column: str = "prompt",
) -> DataFrame:
    """Answers for all prompts through a cache table that is extended on the way.

    The new answers are written before they are read back, so a prompt goes to
    the model once even if the result is evaluated several times or an executor
    is lost later. A prompt that fails comes back with its ``error`` and is not
    cached; each run's answers stay beside the table, under ``<cache_path>-runs``.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("prompt_md5", prompt_key(column))
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        cache = spark.read.schema(PROMPT_CACHE).parquet(cache_path)
    else:
        cache = spark.createDataFrame([], PROMPT_CACHE)
    fresh = fresh_cache(cache, now, ttl_seconds)
    run = f"{cache_path.rstrip('/')}-runs/{uuid.uuid4().hex}"
    _answers(keyed, fresh, models, model, column).write.parquet(run)
    answered = spark.read.parquet(run)
    good = answered.filter("error IS NULL").select("prompt_md5", "response", F.lit(now).alias("created_at"))
    if not good.isEmpty():
        good.write.mode("append").parquet(cache_path)
    known = fresh.withColumn("error", F.lit(None).cast("string")).unionByName(answered)
    return keyed.join(known, "prompt_md5", "left")
