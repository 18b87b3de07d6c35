"""A DB-API connection that notes what is committed in a folder; no database behind it."""

import json
import os
import uuid
from dataclasses import dataclass


@dataclass(frozen=True)
class Connect:
    folder: str
    fail_on: str | None = None

    def __call__(self):
        _note(self.folder, "open", {})
        return Connection(self)


class Connection:
    def __init__(self, origin):
        self._origin, self._pending = origin, []

    def cursor(self):
        return self

    def execute(self, sql):
        self._pending.append({"sql": sql, "rows": None})

    def executemany(self, sql, rows):
        rows = [[str(v) if v is not None else None for v in row] for row in rows]
        poison = self._origin.fail_on
        if poison and any(poison in row for row in rows):
            raise RuntimeError("refused")
        self._pending.append({"sql": sql, "rows": rows})

    def commit(self):
        _note(self._origin.folder, "commit", self._pending)
        self._pending = []

    def rollback(self):
        _note(self._origin.folder, "rollback", {})
        self._pending = []

    def close(self):
        _note(self._origin.folder, "close", {})


def _note(folder, kind, content):
    name = os.path.join(folder, f"{kind}-{uuid.uuid4().hex}.json")
    with open(name, "w") as out:
        json.dump(content, out)


def notes(folder, kind):
    found = []
    for name in sorted(os.listdir(folder)):
        if name.startswith(f"{kind}-"):
            with open(os.path.join(folder, name)) as source:
                found.append(json.load(source))
    return found
