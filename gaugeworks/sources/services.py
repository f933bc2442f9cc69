"""Live model sources: a chat service over HTTP and a command line.

Calls run within the executors and only record what came back; what it means is
decided by the same columns that read recorded replies.  A call never raises: a
failure is a transport word.  At most ``pool`` calls run at a time.  With
``Calls`` every reply is kept as it comes, so that a lost executor's or a failed
wave's answered cells are not called again, and calls stop at the budget: cells
beyond it are ``refused`` and stay without a reply.
"""

from __future__ import annotations

import contextlib
import json
import os
import signal
import socket
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import judge_prompt
from gaugeworks.operators import replies as R
from gaugeworks.schemas import NO_RESPONSE
from gaugeworks.sources.calls import Calls, Desk

Replies = Callable[..., DataFrame]


def _post(url: str, value: dict, timeout: float) -> tuple[str | None, str | None]:
    """(body, transport word) of one POST."""
    request = urllib.request.Request(url, json.dumps(value).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            raw = answer.read()
    except TimeoutError:
        return None, "timeout"
    except urllib.error.URLError as e:
        return None, "timeout" if isinstance(e.reason, TimeoutError) else "unreachable"
    except OSError:
        return None, "os_error"
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "non_json_body"


def _run(argv: Sequence[str], text: str, timeout: float) -> tuple[str | None, int, str | None]:
    """(output, return code, transport word) of one command with ``text`` as its input; a timeout ends its whole group."""
    try:
        process = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, encoding="utf-8", errors="replace", start_new_session=True)
    except FileNotFoundError:
        return None, -1, "unreachable"
    except OSError:
        return None, -1, "os_error"
    try:
        return process.communicate(text, timeout=timeout)[0], process.returncode, None
    except subprocess.TimeoutExpired:
        os.killpg(process.pid, signal.SIGKILL)
        process.communicate()
        return None, -1, "timeout"
    except OSError:
        return None, -1, "os_error"


#: Replies that a task holds before it gives them on.
GIVEN = 16


def each(todo: DataFrame, call: Callable[[str, str], tuple], failed: tuple, fields: str, pool: int, calls: Calls | None = None, sound: Callable[[tuple], bool] = lambda reply: True) -> DataFrame:
    """``todo`` with the columns of ``call(model, prompt)``, elapsed_s and refused.

    With ``calls``, a call that raises gives ``failed`` and only a ``sound`` reply
    is kept in the journal; without, nothing is kept and an exception ends the job.
    """
    names = [x.split()[0] for x in fields.split(", ")]
    keyed = todo.withColumn("_key", F.sha2(F.to_json(F.struct(*sorted(todo.columns)), {"ignoreNullFields": "false"}), 256))
    schema = ", ".join(f"`{n}` {k}" for n, k in keyed.dtypes)

    def answer(desk: Desk | None, key: str, model: str, prompt: str) -> tuple:
        if desk and (known := desk.known(key)) is not None:
            return (*known, False)
        if desk and not desk.granted():
            return (*(None for _ in names), 0.0, True)
        began = time.monotonic()
        try:
            reply = tuple(call(model, prompt))
        except Exception:
            if desk is None:
                raise
            reply = failed  # whatever a caller does, its neighbours' replies stay
        reply = (*reply, round(time.monotonic() - began, 3))
        if desk and sound(reply):
            desk.keep(key, list(reply))
        return (*reply, False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with calls.desk() if calls else contextlib.nullcontext() as desk:
            for frame in frames:
                for at in range(0, len(frame), GIVEN):
                    part = frame.iloc[at : at + GIVEN].reset_index(drop=True)
                    out = [answer(desk, *cell) for cell in zip(part["_key"], part["model"], part["prompt"])]
                    yield pd.concat([part, pd.DataFrame(out, columns=[*names, "elapsed_s", "refused"])], axis=1)

    return keyed.repartition(pool).mapInPandas(run, f"{schema}, {fields}, elapsed_s double, refused boolean").drop("_key")


def live(replies: Replies) -> Replies:
    """Mark replies that take ``calls`` and may refuse."""
    replies.live = True
    return replies


def chat(base_url: str, max_tokens: int = 2000, timeout: float = 120.0, pool: int = 1) -> Replies:
    """Replies of a chat-completions service, one POST a cell."""

    def call(model: str, prompt: str) -> tuple[str | None, str | None]:
        return _post(f"{base_url}/chat/completions", {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": max_tokens}, timeout)

    def replies(todo: DataFrame, calls: Calls | None = None) -> DataFrame:
        return R.chat_reply(each(todo, call, (None, "os_error"), "body string, transport string", pool, calls), F.col("model")).drop("body", "transport")

    return live(replies)


def command(argv: Sequence[str], timeout: float = 300.0, pool: int = 2) -> Replies:
    """Replies of a command that reads the prompt and prints a JSON envelope; ``{model}`` in its words is the cell's model."""
    words = list(argv)

    def call(model: str, prompt: str) -> tuple[str | None, int, str | None]:
        return _run([x.replace("{model}", model) for x in words], prompt, timeout)

    def replies(todo: DataFrame, calls: Calls | None = None) -> DataFrame:
        return R.cli_reply(each(todo, call, (None, -1, "os_error"), "stdout string, returncode int, transport string", pool, calls), F.col("model")).drop("stdout", "returncode", "transport")

    return live(replies)


def reachable(base_url: str, timeout: float = 2.0) -> bool:
    """Whether the service's host takes a connection."""
    parts = urllib.parse.urlsplit(base_url)
    try:
        with socket.create_connection((parts.hostname or "", parts.port or (443 if parts.scheme == "https" else 80)), timeout):
            return True
    except OSError:
        return False


def judge_samples(rows: DataFrame, items: DataFrame, judges: Sequence[str], samples: int, replies: Replies, calls: Calls | None = None) -> DataFrame:
    """(model, item_id, sample_k, judge, ok, response_raw, refused): ``samples`` gradings by each judge of every row with a text.

    ``items`` has (item_id, prompt, expected), the rubric in ``expected``.  A
    call that gave no text is not ok, and counts in no parse statistics.  Each grading is a
    call of its own and spends the budget of ``calls``.
    """
    names = list(dict.fromkeys(judges))
    told = rows.where(F.col("error").isNull() & (F.coalesce("scorer", F.lit("")) != NO_RESPONSE)).join(items.select("item_id", F.col("prompt").alias("asked"), "expected"), "item_id")
    todo = told.select(F.col("model").alias("graded"), "item_id", "sample_k", judge_prompt(F.col("asked"), F.col("response_raw"), F.col("expected")).alias("prompt"), F.explode(F.array(*map(F.lit, names))).alias("model"))
    todo = todo.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("turn"))
    found = replies(todo, calls) if getattr(replies, "live", False) else replies(todo).withColumn("refused", F.lit(False))
    return found.select(F.col("graded").alias("model"), "item_id", "sample_k", F.col("model").alias("judge"), (F.col("state") == "success").alias("ok"), "response_raw", "refused")
