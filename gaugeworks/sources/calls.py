"""Live calls that tasks make once and within a budget, by files in a folder that all executors reach.

Journal: a reply is kept under its cell's key before the task goes on, by
writing a file aside and renaming it.  Whoever meets the cell again, be it a
retried task after a lost executor or the next sweep after a failed wave,
takes the reply from there.

Budget: calls are dealt as files, ``free/start-n`` for a lease of n calls.  A
task takes a lease by renaming it, which succeeds for one task only, counts
each call in the name of its file before it makes it, and gives the rest back
when it ends.  A task that dies leaves the count behind: ``reclaim`` frees what
it had not begun, and takes the lease from it should it still run.  So all
tasks of all steps that share a budget make exactly as many calls as were
dealt, if there is enough to do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession

from gaugeworks.errors import RunError
from gaugeworks.sources.tables import remove

#: Leases of a budget; a task holds one at a time.
LEASES = 256


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    uri = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    try:
        store, path = fs.FileSystem.from_uri(uri)
    except (ValueError, OSError) as e:
        raise RunError(f"live calls cannot be kept in {folder}: {e}") from e
    return store, path.rstrip("/")


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _put(store: fs.FileSystem, path: str, text: str = "") -> None:
    with store.open_output_stream(path) as out:
        out.write(text.encode())


@dataclass(frozen=True)
class Budget:
    """Calls dealt in a folder; the driver's view and, as it travels, the tasks'."""

    folder: str
    total: int

    @classmethod
    def deal(cls, folder: str, total: int) -> Budget:
        if type(total) is not int or total < 1:
            raise RunError("the budget must be at least 1")
        out = cls(f"{folder}/budget-{uuid.uuid4().hex}", total)
        store, path = _open(out.folder)
        for part in ("free", "taken", "spent"):
            store.create_dir(f"{path}/{part}", recursive=True)
        size = -(-total // LEASES)
        for start in range(0, total, size):
            _put(store, f"{path}/free/{start}-{min(size, total - start)}")
        return out

    def left(self) -> int:
        """Calls that nobody has begun, once no task holds a lease."""
        store, path = _open(self.folder)
        return sum(int(x.split("-")[1]) for x in _names(store, f"{path}/free"))

    def reclaim(self) -> int:
        """Free what ended tasks have left of their leases; gives what is left in all."""
        store, path = _open(self.folder)
        for name in _names(store, f"{path}/taken"):
            start, n, used = map(int, name.split("-"))
            try:
                store.move(f"{path}/taken/{name}", f"{path}/spent/{start}-{used}")
            except OSError:  # its task is still at work: it has counted on, or ended
                continue
            if used < n:
                _put(store, f"{path}/free/{start + used}-{n - used}")
        return self.left()


class Desk:
    """A task's place: grants calls and keeps replies.  Without a budget every call is granted."""

    def __init__(self, journal: str, budget: Budget | None) -> None:
        self.store, self.journal = _open(journal)
        self.budget = _open(budget.folder)[1] if budget else None
        self.start = self.n = self.used = 0

    def __enter__(self) -> Desk:
        return self

    def __exit__(self, *_: Any) -> None:
        if self.budget and self.n:
            start, n, used = self.start, self.n, self.used
            self.n = 0
            if self._moved(f"taken/{start}-{n}-{used}", f"spent/{start}-{used}") and used < n:
                _put(self.store, f"{self.budget}/free/{start + used}-{n - used}")

    def _moved(self, source: str, target: str) -> bool:
        try:
            self.store.move(f"{self.budget}/{source}", f"{self.budget}/{target}")
        except OSError:
            return False
        return True

    def granted(self) -> bool:
        """Whether one more call may be made; it counts from now on."""
        if self.budget is None:
            return True
        while True:
            if self.used < self.n:
                if self._moved(f"taken/{self.start}-{self.n}-{self.used}", f"taken/{self.start}-{self.n}-{self.used + 1}"):
                    self.used += 1
                    return True
                self.n = self.used = 0  # the lease was reclaimed
            elif self.n:
                self.__exit__()
            if not self._lease():
                return False

    def _lease(self) -> bool:
        while free := _names(self.store, f"{self.budget}/free"):
            turn = uuid.uuid4().int % len(free)  # tasks begin at different leases
            for name in free[turn:] + free[:turn]:
                if self._moved(f"free/{name}", f"taken/{name}-0"):
                    (self.start, self.n), self.used = map(int, name.split("-")), 0
                    return True
        return False

    def _path(self, key: str) -> str:
        return f"{self.journal}/{key[:2]}/{key}.json"

    def known(self, key: str) -> list[Any] | None:
        path = self._path(key)
        if self.store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.store.open_input_stream(path) as held:
            return json.loads(held.read())

    def keep(self, key: str, reply: list[Any]) -> None:
        path = self._path(key)
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        _put(self.store, aside, json.dumps(reply))
        try:
            self.store.move(aside, path)
        except OSError:  # some stores do not replace: another attempt has kept its reply
            self.store.delete_file(aside)


@dataclass(frozen=True)
class Calls:
    """Where the calls of a step are kept, and what grants them."""

    journal: str
    budget: Budget | None = None

    def desk(self) -> Desk:
        return Desk(self.journal, self.budget)

    def answered(self) -> Iterator[str]:
        """Keys of the replies that are kept."""
        store, path = _open(self.journal)
        for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                yield info.base_name[:-5]

    def forget(self, spark: SparkSession) -> None:
        """Drop replies that are committed elsewhere."""
        remove(spark, self.journal)
