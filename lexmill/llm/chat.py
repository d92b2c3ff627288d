"""Chat windows of a token budget, cut between turns.

The system turn (the first turn, if its role is ``system``) opens every window. Prefix
sums of turn tokens choose the spans: a window takes new turns from the first not yet
used one up to the last whose prefix sum stays within the budget, after the system turn
and a limited history: the longest run of turns just before the span within
HISTORY tokens. History and system turns are repeated for context and masked, as are all
turns not by the assistant; so each assistant turn is a target in exactly one window.

Plan: tokens (words and single punctuation marks) are counted in the JVM, one shuffle by
conversation sorts the turns, and one Arrow pass over the sorted stream cuts the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

BUDGET, HISTORY = 512, 128
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WINDOWS = "conv_id long, window long, first_turn long, last_turn long, history_turns long, tokens long, target_tokens long, text string, mask string"


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def spans(counts: np.ndarray, room: int, history: int) -> list[tuple[int, int, int]]:
    """(first new turn, first turn shown, end) of each window over turns of ``counts`` tokens, by prefix sums."""
    prefix = np.concatenate([[0], np.cumsum(counts)])
    out, start, back = [], 0, 0
    while start < len(counts):
        # first prefix beyond the room; the turn that reaches it opens the next window
        end = max(start + 1, int(np.searchsorted(prefix, prefix[back] + room, side="right")) - 1)
        out.append((start, back, end))
        start = end
        if start < len(counts):
            limit = min(history, max(0, room - int(counts[start])))
            back = int(np.searchsorted(prefix, prefix[start] - limit, side="left"))
    return out


def _conversation(conv: int, turns: list, roles: list, texts: list, counts: list, budget: int, history: int) -> Iterator[tuple]:
    lead = int(roles[0] == "system")
    system = counts[0] if lead else 0
    shown = [f"<|{r}|>{t}" for r, t in zip(roles, texts)]
    own = np.array(counts[lead:], np.int64)
    answers = np.array([r == "assistant" for r in roles[lead:]], bool)
    for k, (start, back, end) in enumerate(spans(own, max(0, budget - system), history)):
        mask = "0" * (lead + start - back) + "".join("1" if a else "0" for a in answers[start:end])
        text = "\n".join(shown[:lead] + shown[lead + back : lead + end])
        yield conv, k, turns[lead + start], turns[lead + end - 1], start - back, system + int(own[back:end].sum()), int(own[start:end][answers[start:end]].sum()), text, mask


def _windower(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [x.split()[0] for x in WINDOWS.split(", ")]

        def windows(held: list[list]) -> Iterator[pa.RecordBatch]:
            convs = np.array(held[0])
            at = np.flatnonzero(np.append(True, convs[1:] != convs[:-1])).tolist()
            rows = [w for a, b in zip(at, [*at[1:], len(convs)]) for w in _conversation(held[0][a], *(c[a:b] for c in held[1:]), budget, history)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(i).to_pylist() for i in range(5)]
            # the last conversation of a batch may go on in the next one
            cut = next((i for i in range(batch.num_rows - 1, -1, -1) if columns[0][i] != columns[0][-1]), -1) + 1
            if held[0] and held[0][0] != columns[0][0]:
                yield from windows(held)
                held = [[], [], [], [], []]
            if cut:
                yield from windows([h + c[:cut] for h, c in zip(held, columns)])
                held = [c[cut:] for c in columns]
            else:
                held = [h + c for h, c in zip(held, columns)]
        if held[0]:
            yield from windows(held)

    return run


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: conv_id, window, first_turn, last_turn, history_turns, tokens, target_tokens, text, mask.

    ``first_turn`` and ``last_turn`` are the span of new turns; ``text`` has every turn as
    ``<|role|>`` and its text, joined by new lines; ``mask`` has a 1 for each turn that is a target and a 0
    for each that is not.

    * A turn larger than what is left of the budget makes a window of its own and is not cut; the history then shrinks, to nothing if need be.
    * A null text counts as empty, a null role as ``user``; rows without conv_id or turn are ignored.
    * Repeated (conv_id, turn) rows are all kept, ordered by role and text.
    * A conversation of a system turn alone has no window. Other columns are ignored, whatever
      their names; an empty table gives an empty result.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("user")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.filter("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), tokens(F.col("text").cast("string")).alias("n"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.transform(map_batches, _windower(budget, history), WINDOWS)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows(table(spark, sf_dir, "conversations"))


OP5_SQL = f"""
WITH RECURSIVE counted AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+|[^\\t\\n\\v\\f\\r \\p{{L}}\\p{{N}}]')) AS n
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM counted),
systems AS (SELECT conv_id, text, n FROM ranked WHERE k = 1 AND role = 'system'),
plain AS (
  SELECT r.conv_id, r.turn, r.role, r.text, r.n, row_number() OVER w - 1 AS i, sum(r.n) OVER w AS upto,
         greatest(0, {BUDGET} - coalesce(s.n, 0)) AS room
  FROM ranked r LEFT JOIN systems s ON s.conv_id = r.conv_id
  WHERE NOT (r.k = 1 AND r.role = 'system')
  WINDOW w AS (PARTITION BY r.conv_id ORDER BY r.turn, r.role, r.text ROWS UNBOUNDED PRECEDING)),
marked AS (
  SELECT p.*, (SELECT min(h.i) FROM plain h WHERE h.conv_id = p.conv_id AND h.i <= p.i
               AND (p.upto - p.n) - (h.upto - h.n) <= least({HISTORY}, greatest(0, p.room - p.n))) AS history_start
  FROM plain p),
walk AS (
  SELECT conv_id, 0 AS win, 0::BIGINT AS start, 0::BIGINT AS back FROM plain WHERE i = 0
  UNION ALL
  SELECT w.conv_id, w.win + 1, m.i, m.history_start FROM walk w, LATERAL (
    SELECT p.i, p.history_start FROM marked p, plain b
    WHERE p.conv_id = w.conv_id AND b.conv_id = w.conv_id AND b.i = w.back AND p.i > w.start
      AND p.upto - (b.upto - b.n) > p.room ORDER BY p.i LIMIT 1) m),
spans AS (
  SELECT conv_id, win, start, back,
         coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY win), (SELECT count(*) FROM plain p WHERE p.conv_id = walk.conv_id)) - 1 AS last
  FROM walk),
shown AS (
  SELECT s.conv_id, s.win, s.start, s.back, s.last, -1 AS i, NULL::BIGINT AS turn, 'system' AS role, y.text, y.n FROM spans s JOIN systems y USING (conv_id)
  UNION ALL
  SELECT s.conv_id, s.win, s.start, s.back, s.last, p.i, p.turn, p.role, p.text, p.n FROM spans s JOIN plain p ON p.conv_id = s.conv_id AND p.i BETWEEN s.back AND s.last)
SELECT conv_id, win AS "window", max(CASE WHEN i = start THEN turn END) AS first_turn, max(CASE WHEN i = last THEN turn END) AS last_turn,
       max(start - back) AS history_turns, sum(n)::BIGINT AS tokens,
       sum(CASE WHEN i >= start AND role = 'assistant' THEN n ELSE 0 END)::BIGINT AS target_tokens,
       string_agg('<|' || role || '|>' || text, chr(10) ORDER BY i) AS text,
       string_agg(CASE WHEN i >= start AND role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) AS mask
FROM shown GROUP BY conv_id, win
"""
