"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, which is then rendered.

A state is a role, and whether a line opens a turn or continues it.  A line is seen through its
speaker marker, its length, its last character, and whether it opens a record.  Transitions and emissions are counted from
labelled transcripts.  Lines are placed in order over the cluster and cut into blocks, so that no
task ever holds a long conversation.  Viterbi runs over all conversations of a block side by side.
One that goes on over several blocks first gives the best scores between its first and last states
in each; these small matrices are chained, level by level where there are many, and fix its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, write_table

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r opens a turn: 2 r; continues it: 2 r + 1
BLOCK_BITS, FAN_BITS = 12, 12
IMPOSSIBLE = -1e18
FOLDS = 5
LENGTHS, ENDS = 12, ("?", ".", ":", ",")
# Names that open a line, by role.
MARKERS = {"system": ["system", "instruction", "instructions"], "user": ["user", "human", "question", "customer", "prompter", "q"], "assistant": ["assistant", "ai", "bot", "gpt", "answer", "agent", "model", "a"]}
_NAMES = "|".join(n for names in MARKERS.values() for n in sorted(names, key=len, reverse=True))
MARKER = rf"(?i)^\s*(?:[#>*\[<|]+\s*)?({_NAMES})\s*(?:[\]>|*]+\s*:?|:)\s*"
#: The share of a role's opening lines that its own marker counts as beforehand, seen or not.
MARKER_SHARE = 0.1
#: The share of each state's lines that count beforehand as first and as later lines of a record: turns may open inside one.
HEAD_SHARE = 0.02


def observed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``mark`` (0 none, 1 to 3 a role's), ``size``, ``ending`` and ``head`` (first line of its record), small numbers."""
    name = F.lower(F.regexp_extract("text", MARKER, 1))
    mark = F.coalesce(*[F.when(name.isin(*names), F.lit(k + 1)) for k, names in enumerate(MARKERS.values())], F.lit(0))
    ending = F.coalesce(*[F.when(F.rtrim("text").endswith(e), F.lit(k + 1)) for k, e in enumerate(ENDS)], F.lit(0))
    size = F.least(F.lit(LENGTHS - 1), F.floor(F.log2(1.0 + F.char_length("text"))).cast("int"))
    return lines.withColumns({"mark": mark, "size": size, "ending": ending, "head": (F.col("line") == 0).cast("int")})


def placed_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line, role, text, place, block): the lines of all turns, numbered in order over the whole table.

    Null texts are one empty line.  Equal (conv_id, turn) are ordered by role and text.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("whole"))
    lines = rows.select("conv_id", "turn", "role", F.xxhash64("whole").alias("tie"), F.posexplode(F.split("whole", "\n")).alias("line", "text"))
    order = ["conv_id", "turn", "role", "tie", "line"]
    ordered = lines.repartitionByRange(*order, "text").sortWithinPartitions(*order, "text")
    return write_table(observed(ordered.drop("tie")).withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", BLOCK_BITS)), "chat-lines")


def _state(role: F.Column, opens: F.Column) -> F.Column:
    return F.coalesce(*[F.when(role == r, F.lit(2 * k)) for k, r in enumerate(ROLES)]) + F.when(opens, 0).otherwise(1)


class TurnModel:
    """Log probabilities: ``start`` (state), ``move`` (state, state), and of the four features by state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, mark: np.ndarray, size: np.ndarray, ending: np.ndarray, head: np.ndarray):
        prior = np.full((STATES, 4), 1e-6)
        for r in range(len(ROLES)):
            prior[2 * r, r + 1] = max(1.0, MARKER_SHARE * mark[2 * r].sum())
        allowed = np.ones((STATES, STATES))
        for r in range(len(ROLES)):
            allowed[:, 2 * r + 1] = 0
            allowed[[2 * r, 2 * r + 1], 2 * r + 1] = 1  # only the same role goes on
        logs = lambda counts: np.log(counts / counts.sum(axis=-1, keepdims=True))
        with np.errstate(divide="ignore"):
            self.move = np.maximum(logs((move + 0.5) * allowed), -1e9)
            self.start = np.maximum(logs((start + 0.5) * (np.arange(STATES) % 2 == 0)), -1e9)
        self.mark, self.size, self.ending, self.head = logs(mark + prior), logs(size + 0.5), logs(ending + 0.5), logs(head + np.maximum(0.5, HEAD_SHARE * head.sum(axis=1, keepdims=True)))

    def emissions(self, pdf: pd.DataFrame) -> np.ndarray:
        return self.mark[:, pdf["mark"]].T + self.size[:, pdf["size"]].T + self.ending[:, pdf["ending"]].T + self.head[:, pdf["head"]].T

    def matrices(self, seen: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of stretches of lines: the best scores from each state at the first line to each state at the last."""
        best = np.where(np.eye(STATES, dtype=bool)[None], seen[begin][:, None, :], IMPOSSIBLE)
        for k in range(1, int(size.max(initial=0))):
            at = np.flatnonzero(size > k)
            best[at] = (best[at][:, :, :, None] + self.move[None, None]).max(axis=2) + seen[begin[at] + k][:, None, :]
        return best

    def viterbi(self, seen: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best states of all lines, where stretches of lines begin and end in given states (-1: any)."""
        free = first < 0
        best = np.where(free[:, None], self.start[None], np.where(np.arange(STATES)[None] == first[:, None], 0.0, IMPOSSIBLE)) + seen[begin]
        back, path = np.zeros((len(seen), STATES), np.int8), np.zeros(len(seen), np.int64)
        longest = int(size.max(initial=0))
        active = [np.flatnonzero(size > k) for k in range(longest)]
        for k in range(1, longest):
            at = active[k]
            scores = best[at][:, :, None] + self.move[None]
            back[begin[at] + k] = scores.argmax(axis=1)
            best[at] = scores.max(axis=1) + seen[begin[at] + k]
        path[begin + size - 1] = np.where(last < 0, best.argmax(axis=1), last)
        for k in range(longest - 1, 0, -1):
            at = begin[active[k]] + k
            path[at - 1] = back[at, path[at]]
        return path

    def chain(self, blocks: list[np.ndarray], first: int = -1, last: int = -1) -> list[tuple[int, int]]:
        """The first and last states of blocks in a row, given their matrices, and the states at both ends (-1: any)."""
        enter, choices, score = self.start if first < 0 else np.where(np.arange(STATES) == first, 0.0, IMPOSSIBLE), [], None
        for best in blocks:
            came = None
            if score is not None:
                step = score[:, None] + self.move
                came, enter = step.argmax(axis=0), step.max(axis=0)
            total = enter[:, None] + best
            choices.append((total.argmax(axis=0), came))
            score = total.max(axis=0)
        at, ends = int(score.argmax()) if last < 0 else last, []
        for opening, came in reversed(choices):
            ends.append((int(opening[at]), at))
            at = int(came[opening[at]]) if came is not None else at
        return ends[::-1]

    def product(self, blocks: list[np.ndarray]) -> np.ndarray:
        """The matrix of blocks in a row."""
        best = blocks[0]
        for more in blocks[1:]:
            best = (((best[:, :, None] + self.move[None]).max(axis=1))[:, :, None] + more[None]).max(axis=1)
        return best


def train(lines: DataFrame) -> TurnModel:
    """Counts over labelled lines; what reaches the driver is a few hundred sums."""
    known = lines.filter(F.col("role").isin(*ROLES)).withColumn("state", _state(F.col("role"), F.col("line") == 0))
    tables = {name: np.zeros((STATES, width)) for name, width in (("mark", 4), ("size", LENGTHS), ("ending", len(ENDS) + 1), ("head", 2))}
    for name, counts in tables.items():
        for row in known.groupBy("state", name).count().collect():
            counts[row["state"], row[name]] += row["count"]
    # Neighbours inside a block: place k meets place k + 1.
    after = known.select("conv_id", (F.col("place") - 1).alias("place"), F.col("state").alias("to"))
    move, start = np.zeros((STATES, STATES)), np.zeros(STATES)
    for row in known.select("conv_id", "place", "state").join(after, ["conv_id", "place"]).groupBy("state", "to").count().collect():
        move[row["state"], row["to"]] += row["count"]
    heads = known.groupBy("conv_id").agg(F.min_by("state", "place").alias("state"))
    for row in heads.groupBy("state").count().collect():
        start[row["state"]] += row["count"]
    return TurnModel(start, move, tables["mark"], tables["size"], tables["ending"], tables["head"])


def _stretches(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one conversation begin, and how many lines they have."""
    begin = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    return begin, np.diff(np.append(begin, len(conv)))


def _square(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(b).reshape(STATES, STATES) for b in column]


def block_ends(matrices: DataFrame, model: TurnModel, fan_bits: int = FAN_BITS) -> DataFrame:
    """(conv_id, block, first, last): the states at the ends of each conversation's blocks (conv_id, block, best).

    Blocks of a conversation are chained in groups of 2^``fan_bits`` neighbours at most; where there
    are more, the groups' own matrices are chained first, and fix the ends of each group.
    """
    ends_schema = "conv_id long, block long, first int, last int"

    def ended(pdf: pd.DataFrame, ends: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], "first": [e[0] for e in ends], "last": [e[1] for e in ends]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return ended(pdf, model.chain(_square(pdf["best"])))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "block": [int(pdf["block"].iloc[0]) >> fan_bits], "best": [model.product(_square(pdf["best"])).ravel()]})

    def between(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return ended(pdf, model.chain(_square(pdf["best"]), int(outer["first"].iloc[0]), int(outer["last"].iloc[0])))

    most = matrices.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if most <= 1 << fan_bits:
        return matrices.groupBy("conv_id").applyInPandas(whole, ends_schema)
    group = F.shiftright("block", fan_bits).alias("group")
    upper = write_table(matrices.groupBy("conv_id", group).applyInPandas(merged, "conv_id long, block long, best array<double>"), "chat-groups")
    outer = write_table(block_ends(upper, model, fan_bits), "chat-group-ends").withColumnRenamed("block", "group")
    return matrices.groupBy("conv_id", group).cogroup(outer.groupBy("conv_id", "group")).applyInPandas(between, ends_schema)


def label_lines(lines: DataFrame, model: TurnModel, fan_bits: int = FAN_BITS) -> DataFrame:
    """(conv_id, place, state) of every line: the most probable states of each conversation."""
    seen = lines.select("conv_id", "block", "place", "mark", "size", "ending", "head")

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the block's first and last conversations, which may go on in other blocks."""
        pdf = pdf.sort_values("place")
        conv = pdf["conv_id"].to_numpy()
        begin, size = _stretches(conv)
        edge = np.unique([0, len(begin) - 1])
        best = model.matrices(model.emissions(pdf), begin[edge], size[edge])
        return pd.DataFrame({"conv_id": conv[begin[edge]], "block": pdf["block"].iloc[0], "best": list(best.reshape(len(edge), -1))})

    def paths(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        conv = pdf["conv_id"].to_numpy()
        begin, size = _stretches(conv)
        fixed = {c: (f, t) for c, f, t in zip(ends["conv_id"], ends["first"], ends["last"])}
        first, last = (np.array([fixed.get(c, (-1, -1))[k] for c in conv[begin]]) for k in (0, 1))
        return pd.DataFrame({"conv_id": conv, "place": pdf["place"], "state": model.viterbi(model.emissions(pdf), begin, size, first, last)})

    wide = seen.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("conv_id")
    edges = seen.groupBy("block").applyInPandas(matrices, "conv_id long, block long, best array<double>")
    ends = write_table(block_ends(write_table(edges.join(wide, "conv_id"), "chat-matrices"), model, fan_bits), "chat-ends")
    return seen.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(paths, "conv_id long, place long, state int")


def parsed_turns(lines: DataFrame, model: TurnModel) -> DataFrame:
    """(conv_id, first_turn, first_line, role, n_lines, rendered): a row for each recovered turn.

    ``rendered`` is ``<|role|>``, the turn's lines without its speaker marker, and ``<|end|>``.  A
    turn that goes on over blocks of lines has a row in each, so that no row grows without bound;
    put together in order, with line ends between, they are the turn.
    """
    known = write_table(label_lines(lines, model), "chat-states")
    rows = lines.select("conv_id", "turn", "line", "text", "place", "block").join(known, ["conv_id", "place"]).withColumn("opens", F.col("state") % 2 == 0)
    # The turn that a block's first lines continue: the last opening of the blocks before it.
    blocks = rows.groupBy("conv_id", "block").agg(F.max(F.when(F.col("opens"), F.col("place"))).alias("opened"), F.min_by("opens", "place").alias("begins"))
    order = Window.partitionBy("conv_id").orderBy("block")  # a row for each 2^BLOCK_BITS lines
    carried = F.max("opened").over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("conv_id", "block", carried.alias("carried"), (~F.lead("begins", 1, True).over(order)).alias("goes_on"))
    own = F.max(F.when(F.col("opens"), F.col("place"))).over(Window.partitionBy("conv_id", "block").orderBy("place"))
    rows = rows.join(blocks, ["conv_id", "block"]).withColumn("start", F.coalesce(own, "carried"))
    last = F.max("place").over(Window.partitionBy("conv_id", "block"))
    rows = rows.withColumn("unended", F.col("goes_on") & (F.col("place") == last))
    packed = rows.groupBy("conv_id", "block", "start").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "line", "state", "text"))).alias("held"), F.bool_or("unended").alias("unended"))
    head = F.col("held")[0]
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(head["state"] / 2) + 1).cast("int"))
    opens = head["state"] % 2 == 0
    lines_ = F.concat(F.array(F.when(opens, F.regexp_replace(head["text"], MARKER, "")).otherwise(head["text"])), F.transform(F.slice("held", 2, F.size("held")), lambda h: h["text"]))
    rendered = F.concat(F.when(opens, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(""), F.concat_ws("\n", lines_), F.when(F.col("unended"), "").otherwise("\n<|end|>"))
    return packed.select("conv_id", head["turn"].alias("first_turn"), head["line"].alias("first_line"), role.alias("role"), F.size("held").alias("n_lines"), rendered.alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The recovered turns of all conversations, their recorded roles read only where conversations train the model.

    Conversations with crc32(conv_id) mod 5 <> 0 and known roles train it.  Null texts are empty
    lines, null turns come first, null conversations are one conversation; repeated rows are lines
    like any other; an empty table gives no rows; other columns are ignored.
    """
    lines = placed_lines(turns)
    model = train(lines.filter(F.coalesce(F.crc32(F.col("conv_id").cast("string")) % FOLDS != 0, F.lit(False))))
    return parsed_turns(lines.withColumn("conv_id", F.coalesce("conv_id", F.lit(-(2**63)))), model).withColumn("conv_id", F.nullif("conv_id", F.lit(-(2**63))))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE_SQL: dict = {}
