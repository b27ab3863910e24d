"""Message tables (conversation, turn, role, text, optional content blocks): rounds, compaction and repair.

A conversation is the unit that windows partition by; it is bounded by its model's context, not by the corpus.
Message blocks are structs (type, text, id, name, tool_use_id, content, is_error).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space, collapse_text, estimate_tokens

# Fixed values.
KEEP_RESULTS, KEEP_RECENT = 5, 12
MEMORY_LINES, MEMORY_CHARS, LINE_CHARS = 48, 4000, 160
CONTEXT_WINDOW, RESERVED_OUTPUT, BUFFER, MAX_FAILURES = 200_000, 20_000, 13_000, 3
RETRY_MARKER = "[earlier conversation truncated for compaction retry]"
CLEARED = "[Old tool result content cleared]"
STOP_LINE = "... earlier context condensed ..."
BLANK = re.compile(r"\s*")
#: The same characters for column functions.
BLANKS = r"[\s\x1c-\x1f]"
BLOCK = "struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string,is_error:boolean>"


def _order(conv: str, turn: str) -> Window:
    return Window.partitionBy(conv).orderBy(turn)


def rounds(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", has_result: Column | None = None) -> DataFrame:
    """Adds group, from 0: a new one at each user message with text and without a tool result."""
    starts = (F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    if has_result is not None:
        starts = starts & ~has_result
    w = _order(conv, turn)
    first = F.row_number().over(w) == 1
    return messages.withColumn("_s", F.when(first, 0).otherwise(starts.cast("int"))).withColumn("group", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def without_oldest(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """For a retry: drops the oldest fifth of the rounds, at least one and never all; conversations of one round go as
    there is nothing to drop. marker tells that a marker message must come first, as an assistant would else begin."""
    all_ = Window.partitionBy(conv)
    rows = rounds(messages, conv, turn).withColumn("_n", F.max("group").over(all_) + 1)
    drop = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") / 5)), F.col("_n") - 1)
    kept = rows.filter((F.col("_n") >= 2) & (F.col("group") >= drop))
    first = F.row_number().over(_order(conv, turn)) == 1
    return kept.withColumn("marker", F.when(first & (F.col("role") == "assistant"), F.lit(RETRY_MARKER))).drop("_n")


def micro_compacted(results: DataFrame, conv: str = "conv_id", turn: str = "turn", keep: int = KEEP_RESULTS) -> DataFrame:
    """Clears compactable tool results but the last `keep` (at least one) of each conversation; adds cleared and saved."""
    newest = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    old = F.col("compactable") & (newest > max(1, keep)) & (F.col("content") != CLEARED)
    rows = results.filter("compactable").withColumn("cleared", old).unionByName(results.filter("not compactable").withColumn("cleared", F.lit(False)))
    saved = F.when(F.col("cleared"), estimate_tokens(F.col("content"))).otherwise(0)
    return rows.withColumn("saved", saved).withColumn("content", F.when(F.col("cleared"), F.lit(CLEARED)).otherwise(F.col("content")))


def collapsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", keep: int = KEEP_RECENT) -> DataFrame:
    """Collapses long texts of all but the last `keep` messages, in conversations where that saves tokens; the others
    are left out."""
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    all_ = Window.partitionBy(conv)
    rows = messages.withColumn("_back", back).withColumn("_n", F.count(F.lit(1)).over(all_))
    rows = rows.withColumn("_new", F.when(F.col("_back") > keep, collapse_text(F.col("text"))).otherwise(F.col("text")))
    before, after = F.sum(estimate_tokens(F.col("text"))).over(all_), F.sum(estimate_tokens(F.col("_new"))).over(all_)
    rows = rows.withColumn("_a", before).withColumn("_b", after).filter((F.col("_n") > keep + 2) & (F.floor(F.col("_b") * 4 / 3) < F.floor(F.col("_a") * 4 / 3)))
    return rows.withColumn("text", F.col("_new")).drop("_back", "_n", "_new", "_a", "_b")


def token_totals(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Estimated tokens per conversation, padded by 4/3 and cut to a whole number."""
    total = F.sum(estimate_tokens(F.coalesce("text", F.lit(""))))
    return messages.groupBy(conv).agg(F.floor(total * 4 / 3).alias("tokens"))


def should_compact(totals: DataFrame, failures: Column, window: int = CONTEXT_WINDOW) -> DataFrame:
    limit = window - RESERVED_OUTPUT - BUFFER
    return totals.withColumn("compact", (failures < MAX_FAILURES) & (F.col("tokens") >= limit))


def memory_lines(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """`role: text` lines from the start up to the limits of lines and characters, then a stop line where one is cut."""
    line = F.concat(F.col("role"), F.lit(": "), F.substring(collapse_space(F.coalesce("text", F.lit(""))), 1, LINE_CHARS))
    w = _order(conv, turn)
    rows = messages.select(conv, turn, line.alias("line")).withColumn("_k", F.row_number().over(w)).withColumn("_c", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("_k") > 1) & ((F.col("_k") > MEMORY_LINES) | (F.col("_c") >= MEMORY_CHARS))
    rows = rows.withColumn("_over", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_cuts", F.sum("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_cuts <= 1").select(conv, turn, F.when(F.col("_over") == 1, F.lit(STOP_LINE)).otherwise(F.col("line")).alias("line"))


def summaries(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", last: int = 8, chars: int = 300) -> DataFrame:
    """The last messages with text as `role: text` lines, one row per conversation."""
    rows = messages.withColumn("_b", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).filter(F.col("_b") <= last)
    text = F.trim(F.coalesce("text", F.lit("")))
    lines = F.collect_list(F.when(text != "", F.struct(F.col(turn).alias("t"), F.concat(F.col("role"), F.lit(": "), F.substring(text, 1, chars)).alias("x"))))
    return rows.groupBy(conv).agg(lines.alias("l")).select(conv, F.array_join(F.transform(F.array_sort("l"), lambda r: r["x"]), "\n").alias("summary"))


def rewound(messages: DataFrame, turns: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Drops the messages from the turns-th last user text on."""
    is_user = ((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")).cast("int")
    later = F.sum(is_user).over(Window.partitionBy(conv).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("_l", later - is_user).filter(F.col("_l") >= turns).drop("_l")


def first_distinct(rows: DataFrame, group: str, value: str, order: str, cap: int) -> DataFrame:
    """Distinct values per group in the order of their first occurrence, at most cap."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("first", value))).filter(F.col("rank") <= cap)


def repeats(actions: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Adds repeated: how many times in a row the value has stood before, 0 where it changes."""
    w = _order(run, step)
    rows = actions.withColumn("_new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("repeated", F.row_number().over(Window.partitionBy(run, "_island").orderBy(step)) - 1).drop("_new", "_island")


def next_phases(verdicts: DataFrame, run: str, step: str, signature: str) -> DataFrame:
    """Adds next_phase from verdict (pass, fail, blocked): a failure with the same signature as the last one replans."""
    same = F.lag(signature).over(_order(run, step)).eqNullSafe(F.col(signature)) & F.col(signature).isNotNull()
    return verdicts.withColumn("next_phase", F.when(F.col("verdict") == "pass", "done").when(F.col("verdict") == "blocked", "failed").when(same, "replan").otherwise("repair"))


def tool_results(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Tool uses with their results, null where there is none: (conv, turn, id, name, content)."""
    blocks = messages.select(conv, turn, F.explode("blocks").alias("b"))
    uses = blocks.filter("b.type = 'tool_use'").select(conv, turn, F.col("b.id").alias("id"), F.col("b.name").alias("name"))
    results = blocks.filter("b.type = 'tool_result'").groupBy(conv, F.col("b.tool_use_id").alias("id")).agg(F.max("b.content").alias("content"))
    return uses.join(results, [conv, "id"], "left")


def _uses(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["id"])


def _results(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: b["tool_use_id"])


def _some(blocks: Column) -> Column:
    return F.coalesce(blocks, F.array().cast(f"array<{BLOCK}>"))


def recent(messages: DataFrame, keep: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Adds recent: the last `keep` messages of a conversation, and those before them as far as the boundary would part
    a tool use from its result. The boundary is the last place at or before it where it parts none."""
    w = _order(conv, turn)
    pair = (F.col("role") == "user") & (F.lag("role").over(w) == "assistant") & F.arrays_overlap(F.coalesce(F.lag("_uses").over(w), F.array().cast("array<string>")), F.col("_results"))
    rows = messages.withColumn("_uses", _uses(_some(F.col("blocks")))).withColumn("_results", _results(_some(F.col("blocks"))))
    rows = rows.withColumn("_pair", F.coalesce(pair, F.lit(False))).withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(conv)))
    free = F.when(~F.col("_pair") & (F.col("_at") <= F.greatest(F.lit(0), F.col("_n") - keep)), F.col("_at"))
    return rows.withColumn("recent", F.col("_at") >= F.max(free).over(Window.partitionBy(conv))).drop("_uses", "_results", "_pair", "_at", "_n")


def split_recent(messages: DataFrame, keep: int, conv: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(older, newer): the newer messages are sanitized, so that no tool use without a result outlives the cut."""
    both = recent(messages, keep, conv, turn)
    return both.filter("not recent").drop("recent"), sanitized(both.filter("recent").drop("recent"), conv, turn)


def sanitized(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A conversation that can be sent again: assistant turns without content go first; then one with tool uses goes as a
    whole unless the message after it is a user's and has a result for each of them; results that answer no such turn go
    from their message, and the message with them if it has nothing else."""
    w = _order(conv, turn)
    rows = messages.withColumn("blocks", _some(F.col("blocks")))
    content = F.exists("blocks", lambda b: (b["type"] != "text") | F.coalesce(b["text"].rlike(r"\S"), F.lit(False)))
    rows = rows.filter((F.col("role") != "assistant") | content)
    rows = rows.withColumn("_uses", F.when(F.col("role") == "assistant", _uses(F.col("blocks"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_results", F.when(F.col("role") == "user", _results(F.col("blocks"))).otherwise(F.array().cast("array<string>")))
    asks = F.size("_uses") > 0
    answered = asks & (F.lead("role").over(w) == "user") & (F.size(F.array_except("_uses", F.lead("_results").over(w))) == 0)
    rows = rows.withColumn("_asks", asks).withColumn("_answered", F.coalesce(answered, F.lit(False)))
    orphans = (F.size("_results") > 0) & ~F.coalesce(F.lag("_answered").over(w), F.lit(False))
    rows = rows.withColumn("_orphans", orphans).withColumn("blocks", F.when(F.col("_orphans"), F.filter("blocks", lambda b: b["type"] != "tool_result")).otherwise(F.col("blocks")))
    kept = rows.filter((~F.col("_asks") | F.col("_answered")) & (~F.col("_orphans") | (F.size("blocks") > 0)))
    return kept.select(*messages.columns)


def cascade(messages: DataFrame, limit: int, conv: str = "conv_id", turn: str = "turn", keep_results: int = KEEP_RESULTS, keep: int = KEEP_RECENT) -> DataFrame:
    """Compaction by steps until a conversation's padded token estimate is under the limit: (conv, turn, role, text, step).
    messages has compactable, whether a message is a tool result that may be cleared.

    First old tool results are cleared ("micro"); if that doesn't do, long texts before the last `keep` messages are
    collapsed ("collapse"); then, with more than four messages before them, all before them becomes one message of memory
    lines ("memory"). What is left is marked "summary": a model must summarise it. Conversations under the limit from the
    start have the step "none".
    """
    all_, back = Window.partitionBy(conv), Window.partitionBy(conv).orderBy(F.desc(turn))
    tokens = lambda c: F.floor(F.sum(estimate_tokens(F.coalesce(c, F.lit("")))).over(all_) * 4 / 3)
    rows = messages.select(conv, turn, "role", "text", "compactable").withColumn("_back", F.row_number().over(back)).withColumn("_n", F.count(F.lit(1)).over(all_))
    newest = F.row_number().over(Window.partitionBy(conv, "compactable").orderBy(F.desc(turn)))
    clear = F.col("compactable") & (newest > max(1, keep_results)) & (F.col("text") != CLEARED)
    rows = rows.withColumn("_micro", F.when(clear, F.lit(CLEARED)).otherwise(F.col("text"))).withColumn("_cleared", F.max(clear.cast("int")).over(all_))
    rows = rows.withColumn("_short", F.when(F.col("_back") > keep, collapse_text(F.col("_micro"))).otherwise(F.col("_micro")))
    rows = rows.withColumns({"_t0": tokens(F.col("text")), "_t1": tokens(F.col("_micro")), "_t2": tokens(F.col("_short"))})
    shrinks = (F.col("_n") > keep + 2) & (F.col("_t2") < F.col("_t1"))
    rows = rows.withColumn("_base", F.when(shrinks, F.col("_short")).otherwise(F.col("_micro")))
    step = F.when(F.col("_t0") < limit, "none").when((F.col("_cleared") == 1) & (F.col("_t1") < limit), "micro").when(shrinks & (F.col("_t2") < limit), "collapse").when(F.col("_n") > keep + 4, "memory").otherwise("summary")
    rows = rows.withColumn("step", step)
    plain = rows.filter("step in ('none', 'micro', 'collapse')")
    plain = plain.select(conv, turn, "role", F.when(F.col("step") == "none", F.col("text")).when(F.col("step") == "micro", F.col("_micro")).otherwise(F.col("_short")).alias("text"), "step")
    open_ = rows.filter("step in ('memory', 'summary')").select(conv, turn, "role", F.col("_base").alias("text"), "step", "_back")
    old = open_.filter((F.col("step") == "memory") & (F.col("_back") > keep))
    memory = memory_lines(old, conv, turn).groupBy(conv).agg(F.min(turn).alias(turn), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), "line"))), lambda r: r["line"]), "\n").alias("text"))
    rest = open_.filter((F.col("step") == "summary") | (F.col("_back") <= keep)).select(conv, turn, "role", "text", "step")
    return plain.unionByName(rest).unionByName(memory.select(conv, turn, F.lit("user").alias("role"), "text", F.lit("memory").alias("step")))


def offloaded(rows: DataFrame, text: str, limit: int = 16_000, preview: int = 3_000) -> DataFrame:
    """Keeps a preview of texts over the limit; spilled tells which bodies belong in a side table."""
    long = F.length(text) > limit
    return rows.withColumn("spilled", long).withColumn("shown", F.when(long, F.substring(F.col(text), 1, preview)).otherwise(F.col(text)))


def transcript(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Markdown of each conversation."""
    part = F.struct(F.col(turn).alias("t"), F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("x"))
    return messages.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda r: r["x"]), "\n\n").alias("markdown"))


def assembled_calls(fragments: DataFrame, call: list[str], seq: str) -> DataFrame:
    """Tool calls from fragments(id, name, arguments): the last non-empty id and name, arguments joined in order of
    arrival; nameless calls go, bad JSON becomes {}."""
    last = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(seq)))
    args = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce("arguments", F.lit("")).alias("a")))), lambda r: r["a"]), "")
    got = fragments.groupBy(*call).agg(last("id").alias("id"), last("name").alias("name"), args.alias("arguments"))
    valid = F.try_parse_json("arguments").isNotNull()
    return got.filter(F.col("name").isNotNull()).withColumn("arguments", F.when(valid, F.col("arguments")).otherwise("{}"))


def split_message(text: str, most: int) -> Iterator[str]:
    """Pieces of at most `most` characters. A piece ends at the last line end in reach, else at the last space, else at
    its limit, and so does one that would be blank; blanks around a cut go."""
    if most <= 0:
        raise ValueError("a piece needs at least one character")
    at = 0
    while len(text) - at > most:
        reach = text[at : at + most + 1]
        end = next((k for k in (reach.rfind("\n"), reach.rfind(" ")) if k > 0), most)
        piece = reach[:end].rstrip()
        if not piece:
            piece, end = reach[:most], most
        yield piece
        at = BLANK.match(text, at + end).end()
    if at < len(text):
        yield text[at:]


def message_parts(rows: DataFrame, text: str, most: int) -> DataFrame:
    """One row per piece of a message, as split_message cuts it: (.., part, piece). Column functions cut the texts, so that Python
    holds none. Only the first piece may begin with blanks, and thus be blank; all pieces after it are matches of one pattern."""
    if most <= 0:
        raise ValueError("a piece needs at least one character")
    stripped = lambda x: F.regexp_replace(x, rf"(?U){BLANKS}+\z", "")
    reach = F.substring(text, 1, most + 1)
    until = lambda mark: F.nullif(F.regexp_extract(reach, rf"(?s)\A(.+){mark}", 1), F.lit(""))
    end = F.coalesce(until(r"\n"), until(" "), F.substring(text, 1, most))
    blank = stripped(F.col("_end")) == ""  # then the piece is cut at its limit and stays as it is
    taken = F.when(blank, F.substring("_text", 1, most)).otherwise(F.col("_end"))
    # a match ends with the blanks after its piece; the last one, if it is what is left within reach, keeps them
    rest = F.regexp_replace(F.expr("substring(_text, length(_taken) + 1)"), rf"(?U)\A{BLANKS}+", "")
    found = F.regexp_extract_all(rest, F.lit(rf"(?sU)(?:.{{1,{most}}}\z|.{{1,{most}}}(?=\n)|.{{1,{most}}}(?= )|.{{{most}}}){BLANKS}*+"), F.lit(0))
    later = F.transform("_found", lambda x, k: F.when((k < F.size("_found") - 1) | (F.length(x) > most), stripped(x)).otherwise(x))
    first = F.when(blank, F.col("_taken")).otherwise(stripped(F.col("_taken")))
    pieces = F.when(F.length("_text") <= most, F.array("_text")).otherwise(F.concat(F.array(first), later))
    others = [c for c in rows.columns if c != text]
    kept = rows.filter(F.col(text) != "").withColumn("_end", end).withColumnRenamed(text, "_text").withColumn("_taken", taken).withColumn("_found", found)
    return kept.select(*others, F.posexplode(pieces).alias("part", "piece"))
