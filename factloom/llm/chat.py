"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text.  The turns are rendered one more at a time and consecutive outputs are
compared: what the longer output has more is the span of the new turn.  If it doesn't begin with the shorter output,
the template rewrites history.  A second rendering with a probe in place of the text finds where the text lies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

Turn = tuple[str, str]
PROBE = "probe"
#: Turns of a turnwise template that are rendered again with each new one; longer conversations go on from the last turn of
#: the full window.  Other templates may look at any turn, so all turns are rendered again.
WINDOW = 32
TRAINED = "assistant"

#: The control strings of common templates (fixed values).
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))


def escape(text: str) -> str:
    r"""No control string stays: a backslash goes after the first character of each, and before each backslash."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    r"""`<s>`, then for each turn `<|turn|>`, role, line end, text, `<|end|>`, line end; role and text escaped."""
    return "<s>" + "".join(f"<|turn|>{escape(r).replace(chr(10), chr(92) + 'n')}\n{escape(t)}<|end|>\n" for r, t in turns)


#: What a turn adds depends on the turn alone, and on whether it is the first.
marked_turns.turnwise = True


def read_turn(span: str) -> Turn:
    """Role and text of one rendered turn of marked_turns."""
    if not (span.removeprefix("<s>").startswith("<|turn|>") and span.endswith("<|end|>\n")):
        raise ValueError(f"not a turn: {span[:80]!r}")
    head, _, body = span.removeprefix("<s>").removeprefix("<|turn|>").partition("\n")
    role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], head, flags=re.S)
    return role, unescape(body.removesuffix("<|end|>\n"))


class Incremental:
    """Spans of the turns of one conversation, a turn at a time.

    Only a template that says so (turnwise) drops turns beyond the window; for any other the whole prefix is rendered with
    each turn, which takes the conversation's turns in memory and time that grows with their square.
    """

    def __init__(self, template: Callable[[list[Turn]], str] = marked_turns, window: int = WINDOW):
        self.template, self.window = template, window if getattr(template, "turnwise", False) else None
        self.turns: list[Turn] = []
        self.last, self.length, self.rewrites = "", 0, False

    def add(self, role: str, text: str) -> tuple[str, int, int | None, int | None]:
        """The new turn's part of the output, where it begins, and where the text lies in it (null if unknown)."""
        if self.window is not None and len(self.turns) >= self.window:
            self.turns = self.turns[-1:]
            self.last = self.template(self.turns)
        now = self.template([*self.turns, (role, text)])
        at, low, high = self.length, None, None
        if now.startswith(self.last):
            span = now[len(self.last) :]
            probed = self.template([*self.turns, (role, PROBE)])
            if probed.startswith(self.last) and probed.count(PROBE, len(self.last)) == 1:
                head, _, tail = probed[len(self.last) :].partition(PROBE)
                if span.startswith(head) and span.endswith(tail) and len(span) >= len(head) + len(tail):
                    low, high = len(head), len(span) - len(tail)
        else:
            self.rewrites, span = True, now
        self.turns.append((role, text))
        self.last, self.length = now, at + len(span)
        return span, at, low, high


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, object, str, str]]:
    """(begins a conversation, id, role, text) of rows that come ordered by conversation and turn."""
    last, some = None, False
    for b in batches:
        for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            yield not some or conv != last, conv, role or "", text or ""
            last, some = conv, True


def ordered(df: DataFrame) -> DataFrame:
    """The rows by conversation and turn.  Each conversation lies in one partition, through which it streams."""
    return df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def format_turns(df: DataFrame, template: Callable[[list[Turn]], str] = marked_turns, window: int = WINDOW) -> DataFrame:
    """One row a turn: conv_id, position (from 0), role, span (its part of the output), start (in code points), and
    text_start, text_end in the span (null if the template rewrites history there, or changes the text's surroundings).

    Rows are ordered by turn, then role and text, nulls first; a null role or text counts as empty; a null conv_id is a
    conversation of its own.  Of a turnwise template only `window` turns of a conversation are in memory, however long it is;
    of any other, all its turns.
    """

    def run(batches):
        inc, rows, position, size = None, [], 0, 0
        for first, conv, role, text in _walk(batches):
            if first:
                inc, position = Incremental(template, window), 0
            span, at, low, high = inc.add(role, text)
            rows.append((conv, position, role, span, at, low, high))
            position, size = position + 1, size + len(span)
            if size > 1 << 22:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)

    def batch(rows):
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "position", "role", "span", "start", "text_start", "text_end"])

    rows = ordered(df)
    kind = pa.string() if dict(rows.dtypes)["conv_id"] == "string" else pa.int64()
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("string" if kind == pa.string() else "long"))
    return rows.mapInArrow(run, f"conv_id {'string' if kind == pa.string() else 'long'}, position long, role string, span string, start long, text_start long, text_end long")


def digests(df: DataFrame, template: Callable[[list[Turn]], str] = marked_turns, read: Callable[[str], Turn] = read_turn, trained: str = TRAINED, window: int = WINDOW) -> DataFrame:
    """One row a conversation: what reading the formatted output back gives, as counts and digests.

    Rewrites is true if the template changed earlier output; the loss columns are then null.  Turns stream through
    the digests in order, so a conversation of any length takes the memory of `window` turns if the template is turnwise; of any other
    template, that of all its turns.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

    def run(batches):
        state, out = None, []

        def close():
            if state:
                conv, inc, n, turns, chars, loss, sure = state
                out.append((conv, n, turns.hexdigest(), chars if sure else None, loss.hexdigest() if sure else None, inc.length, inc.rewrites))

        for first, conv, role, text in _walk(batches):
            if first:
                close()
                state = [conv, Incremental(template, window), 0, hashlib.sha256(), 0, hashlib.sha256(), True]
            span, _, low, high = state[1].add(role, text)
            got_role, got_text = read(span)
            state[2] += 1
            state[3].update(f"{got_role}\n{got_text}\n".encode())
            if got_role == trained:
                if low is None:
                    state[6] = False
                else:
                    own = unescape(span[low:high])
                    state[4] += len(own)
                    state[5].update(own.encode())
            if len(out) >= 10_000:
                yield batch(out)
                out.clear()
        close()
        yield batch(out)

    def batch(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    rows = ordered(df.withColumn("conv_id", F.col("conv_id").cast("long")))
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


#: A conversation whose texts look like a template's control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like control strings.  Null roles and texts are empty, ties go by role and text,
    repeated rows are turns of their own; a null conv_id is a conversation; see `digests`."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return digests(rows.unionByName(hostile))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, len(regexp_extract_all(role, p)) + len(role) - len(replace(role, chr(10), '')) AS in_role, len(regexp_extract_all(text, p)) AS in_text
  FROM c, (SELECT '\\|<\|turn\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>' AS p))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(8 + len(role) + in_role + 1 + len(text) + in_text + 8))::BIGINT AS formatted_chars, false AS rewrites
FROM e GROUP BY conv_id
"""
