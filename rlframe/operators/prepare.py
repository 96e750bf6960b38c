"""Dataset builders: raw records -> canonical training rows (PR-1..19).

Canonical training row:
``data_source, prompt array<struct<role,content>>, ability,
reward_model struct<style, ground_truth array<string>>, extra_info struct<...>``.
All builders are projections (plus explode/union/join where the record
shape changes); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rlframe.operators.batch import with_global_index


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def user_prompt(content: Column, system: Column | None = None) -> Column:
    msgs = [F.struct(F.lit("user").alias("role"), content.alias("content"))]
    if system is not None:
        msgs.insert(0, F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.array(*msgs)


def gold_answers(golden: str | Column | None = None, answer: str | Column | None = None) -> Column:
    """PR-2: golden_answers list (as strings) -> else [answer] -> else []."""
    empty = F.array().cast("array<string>")
    out = empty
    if answer is not None:
        out = F.when(_c(answer).isNotNull(), F.array(_c(answer).cast("string"))).otherwise(out)
    if golden is not None:
        out = F.when(_c(golden).isNotNull(), F.transform(_c(golden), lambda x: x.cast("string"))).otherwise(out)
    return out


def qa_rows(df: DataFrame, question: str, golds: Column, data_source: str, instruction: str,
            ability: str = "multihop_qa", split: str | None = None, index: str | None = None,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """PR-1: ``"Question: " + q + "\\n" + instruction`` as one user message,
    rule-style reward with the full gold list."""
    content = F.concat(F.lit("Question: "), F.coalesce(_c(question), F.lit("")), F.lit("\n" + instruction))
    cols = [*keep, F.lit(data_source).alias("data_source"), user_prompt(content).alias("prompt"),
            F.lit(ability).alias("ability"),
            F.struct(F.lit("rule").alias("style"), golds.alias("ground_truth")).alias("reward_model")]
    if split is not None:
        cols.append(F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index")).alias("extra_info"))
    return df.select(*cols)


NUM_MARKER_RE = r"#### (\-?[0-9\.\,]+)"


def numeric_rows(df: DataFrame, question: str, answer: str, index: str, split: str,
                 data_source: str, instruction: str, on_missing: str = "error",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """PR-3: first ``#### <number>`` of the answer (commas removed) as the
    gold; question + " " + instruction as the prompt; extra_info keeps the raw
    answer and question. A record without the marker fails the job
    (``on_missing='error'``, as the reference asserts) or is dropped
    (``'drop'``)."""
    a = _c(answer)
    sol = F.when(a.rlike(NUM_MARKER_RE), F.regexp_replace(F.regexp_extract(a, NUM_MARKER_RE, 1), ",", ""))
    if on_missing == "error":
        sol = F.coalesce(sol, F.raise_error(F.lit("no '#### <number>' in answer")).cast("string"))
    d = df.withColumn("_sol", sol)
    if on_missing == "drop":
        d = d.where(F.col("_sol").isNotNull())
    return d.select(
        *keep, F.lit(data_source).alias("data_source"),
        user_prompt(F.concat(_c(question), F.lit(" " + instruction))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("_sol").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index"), a.alias("answer"),
                 _c(question).alias("question")).alias("extra_info"))


def tool_rows(numeric: DataFrame, system_prompt: str, tool_name: str = "calc_gsm8k_reward") -> DataFrame:
    """PR-4: numeric rows with a system message and per-row tool kwargs."""
    return numeric.select(
        "data_source",
        F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                F.col("prompt")[0]).alias("prompt"),
        "ability", "reward_model",
        F.struct("extra_info.*", F.lit(True).alias("need_tools_kwargs"),
                 F.create_map(F.lit(tool_name), F.to_json(F.struct(F.struct(
                     F.col("reward_model.ground_truth").alias("ground_truth")).alias("create_kwargs"))))
                 .alias("tools_kwargs")).alias("extra_info"))


def clean_completion_text(x: str | Column) -> Column:
    """PR-7 text cleanup: ' [title]' -> '. ', drop '[...]' tags, double
    spaces -> single."""
    t = F.regexp_replace(_c(x), r"(?U)^\s+|\s+\z", "")
    t = F.replace(t, F.lit(" [title]"), F.lit(". "))
    t = F.regexp_replace(t, r"\[.*?\]", "")
    return F.replace(t, F.lit("  "), F.lit(" "))


def sentence_completion_rows(df: DataFrame, activity: str, ctx_a: str, ctx_b: str, endings: str,
                             label: str, data_source: str, split: str, index: str,
                             keep: tuple[str, ...] = ()) -> DataFrame:
    """PR-7: context = activity + ': ' + ctx_a + ' ' + capitalised ctx_b
    (first letter upper, rest lower), four cleaned endings, integer label;
    unlabeled rows are dropped."""
    b = _c(ctx_b)
    cap = F.concat(F.upper(F.substring(b, 1, 1)), F.lower(F.substring(b, 2, (1 << 31) - 1)))
    ctx = F.concat(_c(activity), F.lit(": "), _c(ctx_a), F.lit(" "), cap)
    d = df.where(F.length(_c(label).cast("string")) > 0)
    return d.select(
        *keep, F.lit(data_source).alias("data_source"),
        user_prompt(clean_completion_text(ctx)).alias("prompt"),
        F.lit("nlp").alias("ability"),
        F.struct(F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"),
                 _c(label).cast("int").alias("ground_truth"),
                 F.transform(_c(endings), clean_completion_text).alias("choices")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index")).alias("extra_info"))


def pref_to_sft(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """PR-8: every preference pair gives two SFT rows (chosen, rejected)."""
    return df.select(F.col(prompt).alias("prompt"), F.explode(F.array(chosen, rejected)).alias("response"))


def pref_split(df: DataFrame, order: list, frac: float = 0.75) -> DataFrame:
    """PR-9: first ``frac`` of rows (by order) = train, rest = test."""
    d = with_global_index(df, order, "_i")
    n = df.count()
    cut = int(n * frac)
    return d.withColumn("split", F.when(F.col("_i") < cut, F.lit("train")).otherwise(F.lit("test"))).drop("_i")


def pref_to_rl(df: DataFrame, prompt: str, data_source: str, split: str, index: str) -> DataFrame:
    """PR-10: preference prompts as RL rows with a model-style reward."""
    return df.select(F.lit(data_source).alias("data_source"), user_prompt(F.col(prompt)).alias("prompt"),
                     F.lit("alignment").alias("ability"),
                     F.struct(F.lit("model").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"),
                     F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index")).alias("extra_info"))


def concat_sources(frames: list[DataFrame]) -> DataFrame:
    """PR-11 / IO-2: row concat by column name (missing columns NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


LETTERS = ("A", "B", "C", "D")


def mc_rows(df: DataFrame, key: str, question: str, correct: str, wrong: list[str], seed: int,
            data_source: str) -> DataFrame:
    """PR-12: options = correct + wrong answers in a seeded md5 order
    (replacing the reference's unseeded shuffle), rendered ``A) ...``; the
    gold is the letter of the correct option."""
    opts = F.array(*[F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(i))))
                              .alias("h"), F.col(c).alias("t"))
                     for i, c in enumerate([correct] + wrong)])
    d = df.withColumn("_o", F.transform(F.array_sort(opts), lambda x: x["t"]))
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform("_o", lambda t, i: F.concat(F.element_at(letters, i + 1), F.lit(") "), t))
    gold = F.element_at(letters, F.array_position("_o", F.col(correct)).cast("int"))
    return d.select(F.lit(data_source).alias("data_source"), F.col(key),
                    F.concat(F.col(question), F.lit("\n"), F.array_join(lines, "\n")).alias("prompt_text"),
                    gold.alias("gold_letter"))


def code_rows(df: DataFrame, public_tests: str, private_tests: str, date: str, lo: str, hi: str) -> DataFrame:
    """PR-13: concat public + private JSON test lists, collect inputs and
    outputs, keep rows whose date string is in [lo, hi)."""
    sch = "array<struct<input:string,output:string>>"
    tests = F.concat(F.coalesce(F.from_json(F.col(public_tests), sch), F.array().cast(sch)),
                     F.coalesce(F.from_json(F.col(private_tests), sch), F.array().cast(sch)))
    d = df.where((F.col(date) >= lo) & (F.col(date) < hi))
    return d.withColumn("tests", F.to_json(F.struct(F.transform(tests, lambda t: t["input"]).alias("inputs"),
                                                   F.transform(tests, lambda t: t["output"]).alias("outputs"))))


def rough_tokens(text: str | Column) -> Column:
    """TX-15: len(text) // 4."""
    return F.floor(F.length(_c(text)) / 4).cast("long")


def drop_overlong(df: DataFrame, rendered: str, max_tokens: int, counter=rough_tokens) -> DataFrame:
    """PR-14: keep prompts whose rendered token count is <= max_tokens."""
    return df.where(counter(rendered) <= max_tokens)


def media_parts(text: str | Column) -> Column:
    """PR-15: split at <image>/<video> into typed parts: text, marker, text,
    ... (2m+1 parts for m markers); empty text parts are kept, as the
    reference does."""
    t = _c(text)
    texts = F.split(t, "<image>|<video>", -1)
    marks = F.regexp_extract_all(t, F.lit("(<image>|<video>)"), 1)
    n = F.size(texts) + F.size(marks)
    nul = F.lit(None).cast("string")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(
        F.pmod(i, F.lit(2)) == 0, F.struct(F.lit("text").alias("type"), F.element_at(texts, (i / 2 + 1).cast("int")).alias("text")))
        .otherwise(F.struct(F.regexp_replace(F.element_at(marks, ((i + 1) / 2).cast("int")), "[<>]", "").alias("type"),
                            nul.alias("text"))))


def nested_select(col: str | Column, keys: list[str]) -> Column:
    """PR-16: follow a key path, unwrapping one-element lists on the way."""
    c = _c(col)
    for k in keys:
        c = c.getField(k)
    return c


def hash_bucket(key: list[str], seed: int, buckets: int = 100) -> Column:
    """Portable bucket: first 32 bits of md5('k1:k2:...:seed') mod buckets."""
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_split(df: DataFrame, key: list[str], seed: int, train_pct: int = 80) -> DataFrame:
    """PR-17: stable train/test split by hash (replaces a random split)."""
    h = hash_bucket(key, seed)
    return df.withColumn("split", F.when(h < train_pct, F.lit("train")).otherwise(F.lit("test")))


def seeded_order(df: DataFrame, key: list[str], seed: int, epoch: int = 0, out: str = "order") -> DataFrame:
    """PR-18: epoch order by hash -- a seeded shuffle that survives retries
    and does not depend on partitioning. Adds the dense position ``out``."""
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)), F.lit(str(epoch))))
    return with_global_index(df.withColumn("_h", h), [F.col("_h")] + [F.col(k) for k in key], out).drop("_h")


def conversation_table(msgs: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """PR-19: one row per conversation with its ordered message list."""
    return msgs.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.col("role"), F.col("content")))).alias("_m")) \
        .withColumn("messages", F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                    m["content"].alias("content")))).drop("_m")


def boxed_rows(df: DataFrame, problem: str, solution: str, data_source: str, instruction: str,
               split: str, index: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """PR-5: math problems; the gold is the last boxed answer of the
    reference solution (NULL when it has none)."""
    from rlframe.functions.mathans import last_boxed, remove_boxed
    return df.select(
        *keep, F.lit(data_source).alias("data_source"),
        user_prompt(F.concat(_c(problem), F.lit(" " + instruction))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), remove_boxed(last_boxed(solution)).alias("ground_truth"))
        .alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).cast("long").alias("index")).alias("extra_info"))


def image_rows(df: DataFrame, images: str) -> DataFrame:
    """PR-6: multimodal rows keep their image list as a column (binary
    array) next to the canonical fields; nothing is decoded here."""
    return df.withColumn("images", F.col(images))
