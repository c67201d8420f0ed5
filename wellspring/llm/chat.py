"""Conversations in reply order, with quotations replaced by links.

Messages that quote others mark quoted lines with ">", once for each level.
Quoted passages and the messages' own passages are normalised and hashed; a
join by hash within the conversation finds the message that said a passage
first. Passages are looked for whole, by lines, by sentences, and by winnowed
runs of words, so a sentence out of a paragraph or a re-wrapped part of one is
found too. A message's parent is the one that it quotes at the outermost level.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import common

#: Words of a run that is hashed, and neighbouring runs of which one is kept.
RUN, WINDOW = 5, 4
_sentence = re.compile(r"(?<=[.!?…。！？])\s+")
_marks = re.compile(r"\s{0,3}((?:>\s?)+)(.*)", re.S)
#: Lines that introduce a quotation.
_intro = re.compile(
    r"(?:on\b.{1,200}\bwrote|am\b.{1,200}\bschrieb\b.{0,80}|le\b.{1,200}\ba écrit|el\b.{1,200}\bescribió|.{1,80}\bwrote|.{1,80}\bsaid)\s*:\s*"
    r"|-{2,}\s*original message\s*-{2,}|-{2,}\s*forwarded message\s*-{2,}",
    re.I,
)


def parse_message(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """Own text without quotations, and quoted passages (level, lines).

    A passage is a run of lines of one level without an empty line between.
    An introducing line ("... wrote:") goes if a quotation follows.
    """
    own, passages, current = [], [], None
    for line in text.split("\n"):
        m = _marks.fullmatch(line)
        level, body = (m[1].count(">"), m[2].strip()) if m else (0, line)
        if not level:
            own.append(line)
            current = None
            continue
        if own and own[-1] is not None:
            k = len(own) - 1
            while k >= 0 and own[k] is not None and not own[k].strip():
                k -= 1
            if k >= 0 and own[k] is not None and _intro.fullmatch(own[k].strip()):
                del own[k:]
            own.append(None)  # where quotations stood
        if not body or current is None or current[0] != level:
            current = None if not body else (level, [body])
            passages += [current] if current else []
        else:
            current[1].append(body)
    kept = "\n".join(x for x in own if x is not None)
    return re.sub(r"\n{3,}", "\n\n", kept).strip("\n"), passages


def normal(text: str) -> str:
    """Text as it is compared: case folded, white space single, no space at the ends."""
    return " ".join(text.casefold().split())


def prints(words: list[str]) -> list[str]:
    """Winnowed runs of RUN words: of every WINDOW neighbouring runs that with the least hash.

    Texts that share RUN + WINDOW - 1 words in a row share one of these.
    """
    import xxhash

    runs = [" ".join(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]
    order = [xxhash.xxh3_64_intdigest(r) for r in runs]
    return [runs[min(range(i, min(i + WINDOW, len(runs))), key=order.__getitem__)] for i in range(max(1, len(runs) - WINDOW + 1))] if runs else []


def spoken(blocks: list[str]) -> set[str]:
    """The parts of texts by which they are found: the whole, its sentences and its prints."""
    out = set()
    for block in blocks:
        whole = normal(block)
        out |= {whole, *(normal(x) for x in _sentence.split(block)), *prints(whole.split())}
    return out - {""}


def passage_keys(lines: list[str]) -> list[tuple[str, int]]:
    """Passages to look for with weights in characters: the lines together, each line, and their parts."""
    return [(p, len(p)) for p in sorted(spoken([" ".join(lines)]) | {normal(x) for x in lines} - {""})]


def own_keys(text: str) -> list[str]:
    """Passages that a message says: all of it, its paragraphs, its lines, and their parts."""
    blocks = [*re.split(r"\n\s*\n", text), *text.split("\n")]
    return sorted(spoken([text]) | {normal(x) for x in blocks} - {""})


def _parse(src: DataFrame) -> DataFrame:
    import xxhash

    kind = src.schema["conv"].dataType.simpleString()

    def key(p):
        return xxhash.xxh3_64_intdigest(p) - (1 << 63)

    def run(rows):
        out = {k: rows[k] for k in ("conv", "turn", "role")} | {k: [] for k in ("own", "said", "levels", "quoted", "weights", "n_quotes")}
        for t in rows["text"]:
            own, passages = parse_message(t or "")
            looked = [(level, key(p), w) for level, lines in passages for p, w in passage_keys(lines)]
            out["own"].append(own)
            out["said"].append([key(p) for p in own_keys(own)])
            out["n_quotes"].append(len(passages))
            for k, i in (("levels", 0), ("quoted", 1), ("weights", 2)):
                out[k].append([x[i] for x in looked])
        return out

    schema = f"conv {kind}, turn long, role string, own string, said array<long>, levels array<int>, quoted array<long>, weights array<int>, n_quotes int"
    return common.map_text_chunks(src, run, schema, "text")


def quote_links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, level, to_turn, weight): for each level quoted, the earlier message that said most of it first."""
    quoting = parsed.where("n_quotes > 0").select("conv").distinct()
    said = parsed.join(quoting, "conv", "left_semi").select("conv", "turn", F.explode("said").alias("key")).groupBy("conv", "key").agg(F.min("turn").alias("to_turn"))
    asked = parsed.where("n_quotes > 0").select("conv", "turn", F.explode(F.arrays_zip("levels", "quoted", "weights")).alias("x"))
    asked = asked.select("conv", "turn", F.col("x.levels").alias("level"), F.col("x.quoted").alias("key"), F.col("x.weights").alias("w"))
    met = asked.join(said, ["conv", "key"]).where("to_turn < turn")
    votes = met.groupBy("conv", "turn", "level", "to_turn").agg(F.sum("w").alias("weight"))
    best = votes.groupBy("conv", "turn", "level").agg(F.max(F.struct("weight", "to_turn")).alias("b"))
    return best.select("conv", "turn", "level", "b.to_turn", "b.weight")


def thread_roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, root_turn, depth) of messages with a parent, by pointer doubling."""
    jump = durable(parents.select("conv", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while not jump.isEmpty():
        up = jump.select("conv", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        joined = jump.join(up, ["conv", "root_turn"], "left")
        jump = durable(
            joined.select("conv", "turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        )
        if jump.where("moved").isEmpty():
            break
        jump = jump.drop("moved")
    return jump.select("conv", "turn", "root_turn", "depth")


def reply_order(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every message without its quotations, placed in its conversation by replies.

    Returns (conv, turn, role, text, n_quotes, parent_turn, root_turn, depth,
    position). parent_turn is null where nothing earlier is quoted. Threads
    come in the order of their roots, and a thread's messages by turn, so each
    follows what it quotes; position counts from 0 in the conversation. Rows with
    equal conversation and turn are all kept and share their links. Null text
    is empty; messages with a null conversation or turn link to nothing and
    null conversations are ordered as one.

    No conversation is gathered in a task: order comes from a range partitioning
    of all messages and from counts by partition, so one conversation may hold
    most of the table.
    """
    src = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    parsed = durable(_parse(src))
    links = quote_links(parsed.where("conv is not null and turn is not null"))
    parents = links.groupBy("conv", "turn").agg(F.min(F.struct("level", (-F.col("to_turn")).alias("t"))).alias("m"))
    parents = durable(parents.select("conv", "turn", (-F.col("m.t")).alias("parent_turn")))
    threads = parents.join(thread_roots(parents), ["conv", "turn"])
    rows = parsed.drop("said", "levels", "quoted", "weights").join(threads, ["conv", "turn"], "left")
    rows = rows.select("conv", "turn", "role", "own", "n_quotes", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    keys = ["conv", F.col("root_turn").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", F.xxhash64("own")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def number(batches):
        last, count = object(), 0
        for b in batches:
            conv = b.column("conv").to_pylist()
            local = np.empty(len(conv), dtype=np.int64)
            for i, c in enumerate(conv):
                last, count = c, count + 1 if c == last else 0
                local[i] = count
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", local long"
    ordered = durable(ordered.mapInArrow(number, schema))
    sizes = ordered.groupBy("part", "conv").agg((F.max("local") + 1).alias("n"))
    before = sizes.select("part", "conv", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    joined = ordered.alias("o").join(before.alias("b"), F.expr("o.part = b.part and o.conv <=> b.conv"))
    return joined.select(
        F.col("o.conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias(text_col),
        "n_quotes", "parent_turn", "root_turn", "depth", (F.col("before") + F.col("local")).alias("position"),
    )
