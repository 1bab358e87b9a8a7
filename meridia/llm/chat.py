"""Chat formatting by token-level assembly.

Each turn becomes  <|turn|> role <|content|> text <|end|>,  where the three marks are reserved
ids beyond the vocabulary. Role and text are encoded separately and the reserved ids are spliced
in between, so that no text can yield a mark. Control strings that occur in a role or text (the
marks' own strings and those of other common templates) are escaped as well, so that the output
stays unambiguous as text: of n backslashes before a control string 2n + 1 are made, and n again
when it is read back.

A turn is encoded where its row is read. Only ids are then brought together by conversation, in
order of turns, and assembled one turn at a time: the segments' lengths and whether they bear
loss give the mask's steps, and prefix sums over them the mask and each turn's offset. No task
holds more than a turn, however long a conversation.

Defined results: a null role or text counts as empty; turns are in order of turn (null first),
then role and a digest of the text; a null conv_id is a conversation; repeated rows are turns of their own; an
empty table gives an empty result; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import bounded_batches

MARKS = ("<|turn|>", "<|content|>", "<|end|>")
#: Strings that mark turns in this template or in other common ones.
CONTROLS = (*MARKS, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<turn>", "</turn>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "### System:", "### User:", "### Assistant:", "<s>", "</s>")
CONTROL = "(?:" + "|".join(map(regex.escape, CONTROLS)) + ")"
TO_ESCAPE = regex.compile(rf"(\\*)({CONTROL})")
#: A control string behind twice its backslashes and one more.
DOUBLED = r"\1\1\\\2"
ESCAPED = regex.compile(rf"(\\+)({CONTROL})")
TURN = "conv_id long, turn long, role string, text string, ids array<int>, role_ids int, text_ids int, loss boolean"
ASSEMBLED = "conv_id long, position long, start long, ids array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return TO_ESCAPE.sub(DOUBLED, text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


class Template:
    """A byte-level vocabulary, with reserved ids for the marks after its own."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.turn, self.content, self.end = (max(ranks.values()) + 1 + i for i in range(3))
        self.marks = dict(zip((self.turn, self.content, self.end), MARKS, strict=True))

    def encode(self, text: str) -> list[int]:
        return self.vocabulary.encode_ordinary(text)

    def text(self, ids: np.ndarray) -> str:
        """Ids as text, marks included."""
        out, at = [], 0
        for i in np.flatnonzero(ids >= self.turn).tolist():
            out += [self.vocabulary.decode(ids[at:i].tolist()), self.marks[int(ids[i])]]
            at = i + 1
        return "".join([*out, self.vocabulary.decode(ids[at:].tolist())])

    def segment(self, role: str, text: str) -> tuple[list[int], int, int]:
        """A turn's ids, and how many of them are its role's and its text's."""
        a, b = self.encode(escape(role)), self.encode(escape(text))
        return [self.turn, *a, self.content, *b, self.end], len(a), len(b)

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of one turn's ids, still escaped."""
        at = int(np.argmax(ids == self.content))
        return self.vocabulary.decode(ids[1:at].tolist()), self.vocabulary.decode(ids[at + 1 : -1].tolist())


_templates: dict[tuple[str, str], Template] = {}


def template(path: str, pattern: str) -> Template:
    """One per worker process, kept between tasks."""
    if (path, pattern) not in _templates:
        _templates[path, pattern] = Template(path, pattern)
    return _templates[path, pattern]


def encode_turns(path: str, pattern: str, loss_roles: tuple[str, ...]):
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path, pattern)
        for batch in batches:
            role, text = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            made = [own.segment(r, t) for r, t in zip(role, text, strict=True)]
            # The texts themselves go no further than the sort key: digests order equal turns.
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), pa.array(role, pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text], pa.string()),
                    pa.array([m[0] for m in made], pa.list_(pa.int32())),
                    pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()),
                    pa.array([r in loss_roles for r in role], pa.bool_()),
                ],
                names=["conv_id", "turn", "role", "text", "ids", "role_ids", "text_ids", "loss"],
            )

    return run_task


def assemble():
    """Turns sorted by conversation to (position, offset, ids, mask) by prefix sums."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, start = object(), 0, 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "ids", "role_ids", "text_ids", "loss")]
            convs, positions, starts, masks = [], [], [], []
            for c, ids, of_role, of_text, loss in zip(*cols, strict=True):
                if c != conv:
                    conv, position, start = c, 0, 0
                steps = np.zeros(len(ids) + 1, np.int8)
                if loss:
                    first = 1 + of_role + 1
                    steps[first] += 1
                    steps[first + of_text] -= 1
                masks.append(np.cumsum(steps[:-1]).astype(bool))
                convs.append(c), positions.append(position), starts.append(start)
                position, start = position + 1, start + len(ids)
            if convs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(convs, pa.int64()), pa.array(positions, pa.int64()), pa.array(starts, pa.int64()), batch.column("ids"), pa.array(masks, pa.list_(pa.bool_()))],
                    names=["conv_id", "position", "start", "ids", "loss_mask"],
                )

    return run_task


def formatted(conversations: DataFrame, path: str, pattern: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each turn, sorted by conversation within partitions: its position, the offset
    of its ids in the conversation's, the ids and the loss mask."""
    bounded_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    encoded = turns.mapInArrow(encode_turns(path, pattern, loss_roles), TURN)
    together = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "ids", "role_ids", "text_ids", "loss").mapInArrow(assemble(), ASSEMBLED)


def read_back(path: str, pattern: str):
    """Formatted turns to a row of digests for each conversation, read from ids and masks."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path, pattern)
        conv, state = None, None

        def result() -> pa.RecordBatch:
            n, all_turns, loss_chars, loss, chars = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([all_turns.hexdigest()]), pa.array([loss_chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            ids, mask = batch.column("ids"), batch.column("loss_mask")
            ends = ids.offsets.to_pylist()
            every, learnt = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
            shift = mask.offsets[0].as_py() - ends[0]
            for c, a, b in zip(batch.column("conv_id").to_pylist(), ends, ends[1:], strict=False):
                if state is None or c != conv:
                    if state is not None:
                        yield result()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own_ids, masked = every[a:b], learnt[a + shift : b + shift]
                role, text = own.read(own_ids)
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                if masked.any():
                    loss = unescape(own.text(own_ids[masked]))
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(own.text(own_ids))
        if state is not None:
            yield result()

    return run_task


def digests(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row for each conversation, read back from the formatted turns."""
    turns = formatted(conversations, path, pattern).select("conv_id", "ids", "loss_mask")
    return turns.mapInArrow(read_back(path, pattern), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(own.unionByName(probe), vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


def in_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: RE2 reads the same pattern; it doesn't know the escapes that only other engines need.
CONTROL_SQL = in_sql(r"(\\*)(" + "|".join(re.sub(r"([|\[\]()*+?.\\])", r"\\\1", c) for c in CONTROLS) + ")")
ESCAPED_SQL = f"regexp_replace({{}}, {CONTROL_SQL}, {in_sql(DOUBLED)}, 'g')"
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, {in_sql(PROBE)} FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
),
f AS (SELECT *, {sum(map(len, MARKS))} + length({ESCAPED_SQL.format('role')}) + length({ESCAPED_SQL.format('text')}) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
