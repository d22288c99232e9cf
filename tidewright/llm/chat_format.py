"""Chat formatting: conversations as event logs, folded to final messages and rendered with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, tune

#: Marks of the template; a backslash escapes them, and itself, inside roles and texts.
OPEN, CLOSE = "### ", "</turn>\n"
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(col):
    """Backslashes are doubled, then each `###`, `</turn>` and (in roles) `: ` can't be met unescaped."""
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    col = F.replace(col, F.lit("#"), F.lit("\\#"))
    return F.replace(col, F.lit("<"), F.lit("\\<"))


def escape_role(col):
    return F.replace(escape(col), F.lit(":"), F.lit("\\:"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def fold_events(events: DataFrame) -> DataFrame:
    """Event log (conv_id, turn, role, text and, if given, seq and kind) to final messages (conv_id, turn, nth, role, text).

    kind: `message` sets a turn's role and text, `delta` appends to it, `edit` replaces what is there, `regenerate`
    drops the turn's text and that of all later turns of the conversation (deltas after it stream the new one),
    `delete` removes the turn. Events apply by seq; of equal seq by kind and text. Null kind: message; null text:
    empty; null role: that of the turn's earlier events, else empty. Rows of a plain table (one message for each
    turn) pass unchanged, repeated ones too: several `message` events of one seq and turn are several messages.

    A conversation is the partition, in order of seq, for what reaches over turns (regenerations); the rest of the fold
    goes by (conv_id, turn), so that a conversation of any length spreads over tasks. Long texts are folded whole,
    other columns are ignored, an empty log gives no rows.
    """
    plain = "kind" not in events.columns
    at = F.col("seq") if "seq" in events.columns else F.col("turn")
    e = events.select(
        "conv_id", F.coalesce(at, F.lit(0)).alias("seq"), (F.lit("message") if plain else F.coalesce("kind", F.lit("message"))).alias("kind"),
        F.coalesce(F.col("turn"), at, F.lit(0)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    if not plain:
        # the last regeneration of this turn or an earlier one; a conversation's turns go through a window, not its events
        upto = Window.partitionBy("_conv").orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
        turns = e.groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn")).agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"))
        turns = turns.withColumn("_again", F.max("_again").over(upto))
        e = e.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("turn") == F.col("_turn"))).where("_again is null or seq >= _again")
    by_turn = Window.partitionBy("conv_id", "turn")
    in_order = by_turn.orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    # the last event that sets or removes the text; further messages of that same seq stand beside it
    base = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(by_turn)
    e = e.withColumn("base", base).withColumn("role", F.last("role", True).over(in_order)).where("seq >= coalesce(base, seq)")
    nth = F.sum(F.when(F.col("kind").isin("message", "edit"), 1).otherwise(0)).over(in_order)
    gone = F.max((F.col("kind") == "delete").cast("int")).over(by_turn)
    e = e.withColumn("nth", F.greatest(nth, F.lit(1))).withColumn("gone", gone).where("gone = 0 and kind != 'regenerate'")
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("kind") == "delta", 1).otherwise(0).alias("late"), "text")))
    return e.groupBy("conv_id", "turn", "nth").agg(
        F.coalesce(F.max("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def pieces(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per message: conv_id, turn, nth, role, piece, and where in the piece the text stands (at, n), loss.

    A piece is `### role: text</turn>` and a newline, with its role and text escaped, so the output can be read back.
    A conversation is its pieces in order of turn, nth and role; each is rendered where it lies.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": "))
    body = escape(F.col("text"))
    return messages.select(
        "conv_id", "turn", "nth", "role", F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        F.length(head).alias("at"), F.length(body).alias("n"), F.col("role").isin(*loss_roles).alias("loss"),
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages to one row per conversation: conv_id, formatted, loss (spans of formatted, from and to code point).

    A row holds a whole conversation, its longest texts and repeated messages included; where that is too much for one,
    pieces() is the same output in parts. Null roles and texts are empty; no messages give no rows.
    """
    rows = pieces(messages, loss_roles).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "nth", "role", "piece", "at", "n", "loss"))).alias("p"))
    lengths = F.transform("p", lambda x: F.length(x["piece"]))
    span = F.expr(
        "aggregate(zip_with(p, len, (x, l) -> struct(x.at as at, x.n as n, x.loss as loss, l as l)),"
        " struct(0L as pos, cast(array() as array<struct<from:bigint,to:bigint>>) as spans),"
        " (acc, x) -> struct(acc.pos + x.l as pos, if(x.loss, concat(acc.spans, array(struct(acc.pos + x.at as from, acc.pos + x.at + x.n as to))), acc.spans) as spans),"
        " acc -> acc.spans)"
    )
    return rows.withColumn("len", lengths).select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), span.alias("loss"))


_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation; raises ValueError on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_chat(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """fold_events, then render. An empty log gives no rows; a null conv_id is a conversation of its own."""
    tune(events.sparkSession)
    return render(fold_events(events), loss_roles)


def digests(rendered: DataFrame) -> DataFrame:
    """What the pieces of conversations say when they are read back: turns, loss text and lengths of each conversation.

    A task streams through its pieces in order and keeps running digests, so a conversation of any length needs no more
    memory than one piece.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n = (), [0, 0, 0]
        whole, loss = hashlib.sha256(), hashlib.sha256()
        for b in batches:
            done = []
            for conv_id, null, piece, at, length, masked in zip(b["conv_id"], b["null"], b["piece"], b["at"], b["n"], b["loss"], strict=True):
                key = (None if null else int(conv_id),)
                if key != now:
                    if now:
                        done.append((now[0], n[0], whole.hexdigest(), n[1], loss.hexdigest(), n[2]))
                    now, n, whole, loss = key, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for role, text in read_back(piece):
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n[0] += 1
                if masked:
                    text = unescape(piece[at : at + length])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    n[1] += len(text)
                n[2] += len(piece)
            if done:
                yield frame(done)
        if now:
            yield frame([(now[0], n[0], whole.hexdigest(), n[1], loss.hexdigest(), n[2])])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="string" if c.endswith("sha256") else "Int64") for i, c in enumerate(names)})

    order = ["conv_id", "turn", "nth", "role", "piece"]
    rows = rendered.repartition(parts(rendered.sparkSession), "conv_id").sortWithinPartitions(*order)
    rows = rows.select(F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv_id"), F.col("conv_id").isNull().alias("null"), "piece", "at", "n", "loss")
    return rows.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
