"""Chat formatting with typed content parts.

A visitor flattens a message's parts into text: text parts are escaped, image, audio and document parts become ordered
placeholders, and each attachment is recorded with its reference and the number of tokens it expands to. Turns are
wrapped in control strings; control strings inside texts are escaped so that reading back restores them exactly.

Every turn is formatted on its own by the visitor, a plain text being one text part, so a conversation of any length
never has to be in memory: its digests are made by streaming its turns in order.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import map_arrow, slices

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line feed inside a role. No escaped text holds it.
FEED = "<|nl|>"
#: Every "<|" in a text gets a backslash between its two characters, and every "<" followed by backslashes and "|" one backslash more.
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: Tokens that an attachment of each kind expands to: fixed part, and tokens a unit (256 x 256 image tile, second, page).
EXPANSION = {"image": (1, 85), "audio": (1, 25), "document": (1, 400)}
TRAINED_ROLE = "assistant"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def amount(value, default: float = 1.0) -> float:
    """A size of an attachment: a positive, finite number, or a string of one; else the default."""
    try:
        found = float(value)
    except (TypeError, ValueError, OverflowError):
        return default
    return found if 0 < found < 1e15 else default


@dataclass
class Flattened:
    """text: escaped, with placeholders. attachments: (kind, ordinal, reference, tokens, offset of the placeholder)."""

    text: str = ""
    attachments: list[tuple[str, int, str, int, int]] = field(default_factory=list)
    expanded_tokens: int = 0


class PartVisitor:
    """Visits the parts of a message in order. Ordinals run on over a visitor's whole life, so one may serve a conversation.

    Parts are null, strings, or dicts with a type. A dict without type is text; a text part's text, if not a string, is
    written as JSON. What is no part (a number, a list, an unknown type) raises ValueError, or is text, as JSON, where
    ``strict`` is false. Sizes that are no positive number count as one unit.
    """

    def __init__(self, strict: bool = True) -> None:
        self.seen, self.strict = dict.fromkeys(EXPANSION, 0), strict

    def visit(self, content) -> Flattened:
        """content: None, a string, a part, or a list of parts."""
        out = Flattened()
        for part in content if isinstance(content, list) else [content]:
            kind = part.get("type", "text") if isinstance(part, dict) else "text"
            if isinstance(kind, str) and kind in EXPANSION:
                self.attachment(kind, part, out)
            elif kind == "text" and (part is None or isinstance(part, (str, dict))):
                self.text(part.get("text") if isinstance(part, dict) else part, out)
            elif self.strict:
                raise ValueError(f"no such content part: {kind!r}")
            else:
                self.text(part, out)
        return out

    def text(self, value, out: Flattened) -> None:
        if value is not None:
            out.text += escape(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))

    def attachment(self, kind: str, part: dict, out: Flattened) -> None:
        self.seen[kind] += 1
        ordinal = self.seen[kind]
        if kind == "image":
            units = math.ceil(amount(part.get("width"), 256) / 256) * math.ceil(amount(part.get("height"), 256) / 256)
        else:
            units = math.ceil(amount(part.get("seconds" if kind == "audio" else "pages")))
        base, each = EXPANSION[kind]
        tokens = base + each * units
        out.attachments.append((kind, ordinal, str(part.get("ref") or part.get("url") or ""), tokens, len(out.text)))
        out.text += f"<|{kind}_{ordinal}|>"
        out.expanded_tokens += tokens


def whole(text: str) -> str:
    """The text with U+FFFD for each lone surrogate, as long as it was."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def head(role: str) -> str:
    return START + escape(role).replace("\n", FEED) + "\n"


def wrap(role: str, body: str) -> str:
    return f"{head(role)}{body}{END}\n"


def read_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; the exact inverse of wrap() for text parts."""
    if not segment.startswith(START) or not segment.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(START) : -len(END) - 1].partition("\n")
    return unescape(role.replace(FEED, "\n")), unescape(body)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment, loss_start, loss_length, expanded_tokens) of turns (conv_id, turn, role, text).

    The visitor formats each turn's text as one text part. segment is the formatted turn; loss_start and loss_length are
    the code points of it under the loss mask. Null texts and roles are empty; extra columns are left behind.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches):
        for batch in slices(batches):
            roles = batch.column("role").to_pylist()
            flat = [PartVisitor().visit([{"type": "text", "text": t}]) for t in batch.column("text").to_pylist()]
            trained = [r == TRAINED_ROLE for r in roles]
            yield {
                "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": roles,
                "segment": [wrap(r, f.text) for r, f in zip(roles, flat, strict=True)],
                "loss_start": [len(head(r)) if t else 0 for r, t in zip(roles, trained, strict=True)],
                "loss_length": [len(f.text) if t else 0 for f, t in zip(flat, trained, strict=True)],
                "expanded_tokens": [f.expanded_tokens for f in flat],
            }

    return map_arrow(own, work, "conv_id long, turn long, role string, segment string, loss_start long, loss_length long, expanded_tokens long")


def format_parts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, expanded_tokens, attachments) of messages whose ``content`` is JSON: a string or a list of typed parts.

    Null or malformed JSON, JSON nested too deeply to be read, or a bare number, is plain text as it stands; parts of unknown
    types are text, as JSON. Half of a surrogate pair, which JSON can spell and no text can hold, becomes U+FFFD. Ordinals
    start anew in each turn; extra columns are left behind.
    """
    kind = "array<struct<kind:string,ordinal:int,ref:string,tokens:int,offset:int>>"

    def work(batches):
        for pdf in batches:
            rows = []
            for conv_id, turn, role, content in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["content"], strict=True):
                try:
                    parsed = json.loads(content) if content else content
                    flat = PartVisitor(strict=False).visit(parsed if isinstance(parsed, (str, list, dict)) else content)
                except (ValueError, RecursionError):
                    flat = PartVisitor().visit(content)
                attachments = [(kind, k, whole(ref), tokens, at) for kind, k, ref, tokens, at in flat.attachments]
                rows.append((conv_id, turn, wrap(role or "", whole(flat.text)), flat.expanded_tokens, attachments))
            yield type(pdf)(rows, columns=["conv_id", "turn", "segment", "expanded_tokens", "attachments"])

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("content")]
    return messages.select(columns).mapInPandas(work, f"conv_id long, turn long, segment string, expanded_tokens long, attachments {kind}")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns in the order of turn (then role, text; nulls first).

    Turns of a conversation meet in one task, as a SHA-256 has to see them in order, but they stream: only the running
    digest is kept, so the longest conversation needs no more memory than the shortest. Repeated rows are turns of their
    own; a null conv_id is a conversation; an empty table gives none.
    """
    formatted = format_turns(turns).select("conv_id", "turn", "role", "segment", "loss_start", "loss_length")
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def work(batches):
        open_id, state = object(), None
        for batch in batches:
            done = []
            for conv_id, segment, a, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")), strict=True):
                if state is None or conv_id != open_id:
                    if state:
                        done.append(finished(open_id, state))
                    open_id, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[a : a + n])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            if done:
                yield {c: [r[i] for r in done] for i, c in enumerate(names)}
        if state:
            yield {c: [x] for c, x in zip(names, finished(open_id, state), strict=True)}

    return map_arrow(ordered, work, DIGESTS)


def finished(conv_id, state) -> tuple:
    return conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
