"""A command shell over a Store: one line in, its output back."""

from __future__ import annotations

import time
from collections.abc import Callable

from .schema import INT_MAX, INT_MIN, TOMBSTONE
from .store import Store

HELP = """Commands:
  open NAME             open or create a database
  close                 close it
  insert|i KEY VALUE    write a pair
  seq START END STEP    write k -> k for every step
  search|s KEY          look a key up
  scan LOW HIGH         list a range
  delete|d KEY          mark a key as deleted
  size                  pairs in memory
  status                state of the database
  lsm                   runs by level
  compact LEVEL         compact a level
  searchmode MODE       btree or binary; results are the same
  workmode              state of debug output
  test N                time N writes into a scratch database
  clear                 clear the screen
  help                  this text
  exit|quit             close and leave"""

NOT_OPEN = "No database is open; use: open NAME"
SCRATCH = "scratch_test"


class Shell:
    def __init__(self, store: Store) -> None:
        self.store, self.done = store, False

    def execute(self, line: str) -> str:
        """Run a line.  A blank line does nothing."""
        words = line.split()
        if not words:
            return ""
        name = {"i": "insert", "s": "search", "d": "delete", "quit": "exit"}.get(words[0], words[0])
        command: Callable[[list[str]], str] | None = getattr(self, f"_do_{name}", None)
        if command is None:
            return f"Unknown command: {words[0]}\nType help for the list of commands"
        try:
            return command(words[1:])
        except ValueError as e:
            return f"Error: {e}"

    @staticmethod
    def _ints(words: list[str], n: int) -> list[int] | None:
        try:
            found = [int(w) for w in words[:n]]
        except ValueError:
            return None
        return found if len(found) == n and all(INT_MIN <= x <= INT_MAX for x in found) else None

    def _do_help(self, words: list[str]) -> str:
        return HELP

    def _do_exit(self, words: list[str]) -> str:
        self.store.close()
        self.done = True
        return "Goodbye"

    def _do_open(self, words: list[str]) -> str:
        if not words:
            return ""
        return "" if self.store.open(words[0]) else f"Cannot open {words[0]}"

    def _do_close(self, words: list[str]) -> str:
        if not self.store.is_open:
            return "No database is open"
        return "Closed" if self.store.close() else "Closed with errors"

    def _do_insert(self, words: list[str]) -> str:
        if self.store.is_open and (pair := self._ints(words, 2)):
            self.store.insert(*pair)
        return ""

    def _do_seq(self, words: list[str]) -> str:
        if not self.store.is_open:
            return NOT_OPEN
        three = self._ints(words, 3)
        if three is None:
            return "Usage: seq START END STEP"
        self.store.sequence(*three)
        return ""

    def _do_search(self, words: list[str]) -> str:
        if not self.store.is_open:
            return NOT_OPEN
        key = self._ints(words, 1)
        if key is None:
            return "Usage: search KEY"
        value = self.store.get(key[0])
        if value is None:
            return f"Key {key[0]} not found"
        return f"Key {key[0]} is marked as deleted" if value == TOMBSTONE else f"Found: {key[0]} -> {value}"

    def _do_scan(self, words: list[str]) -> str:
        if not self.store.is_open:
            return NOT_OPEN
        ends = self._ints(words, 2)
        if ends is None:
            return "Usage: scan LOW HIGH"
        rows = self.store.scan(*ends).collect()  # what the user asked to see
        if not rows:
            return "No entries found"
        shown = [f"{r.key}\t{r.value}" for r in rows if r.value != TOMBSTONE]
        return "\n".join([f"Found {len(rows)} entries", *(shown or ["All keys in the range are marked as deleted"])])

    def _do_delete(self, words: list[str]) -> str:
        if not self.store.is_open:
            return NOT_OPEN
        key = self._ints(words, 1)
        if key is None:
            return "Usage: delete KEY"
        missing = [f"Key {key[0]} not found for deletion"] if self.store.get(key[0]) is None else []
        self.store.delete(key[0])
        return "\n".join([*missing, f"Deleted key {key[0]}"])

    def _do_size(self, words: list[str]) -> str:
        return f"Memory: {len(self.store.memory)} / {self.store.options.capacity}" if self.store.is_open else NOT_OPEN

    def _do_status(self, words: list[str]) -> str:
        s = self.store
        lines = [f"Database: {s.name or 'not open'}", f"Status: {'open' if s.is_open else 'closed'}"]
        if s.is_open:
            lines += [f"Memory: {len(s.memory)}/{s.options.capacity}", f"Fill level: {len(s.memory) * 100.0 / s.options.capacity:.1f}%"]
        return "\n".join([*lines, f"Search mode: {s.options.search_mode}"])

    def _do_lsm(self, words: list[str]) -> str:
        if not self.store.is_open:
            return NOT_OPEN
        lines = [f"Directory: {self.store.path}", f"Next run: {self.store.manifest.next_number}"]
        for k, runs in enumerate(self.store.levels()):
            lines.append(f"Level {k}: {len(runs)} runs")
            lines += [f"  {r.file_name} [{r.min_key}, {r.max_key}] ({r.num_pairs} pairs)" for r in runs]
        return "\n".join(lines)

    def _do_compact(self, words: list[str]) -> str:
        if not self.store.is_open:
            return NOT_OPEN
        level = self._ints(words, 1)
        if level is None:
            return "Usage: compact LEVEL"
        return f"Level {level[0]} compacted" if self.store.compact_level(level[0]) else f"Level {level[0]} could not be compacted"

    def _do_searchmode(self, words: list[str]) -> str:
        if not words:
            return f"Usage: searchmode btree|binary\nNow: {self.store.options.search_mode}"
        if words[0] not in ("btree", "binary"):
            return f"Invalid search mode {words[0]}; use btree or binary"
        self.store.options.search_mode = words[0]
        return f"Search mode: {words[0]}"

    def _do_workmode(self, words: list[str]) -> str:
        return "Debug output: off"

    def _do_clear(self, words: list[str]) -> str:
        return "\033[2J\033[H"

    def _do_test(self, words: list[str]) -> str:
        n = self._ints(words, 1)
        if n is None or n[0] < 1:
            return "Usage: test N, with N above 0"
        before = self.store.name
        self.store.close()
        self.store.open(SCRATCH)
        began = time.perf_counter()
        self.store.sequence(1, n[0])
        took = time.perf_counter() - began
        self.store.close()
        self.store.drop(SCRATCH)
        if before is not None:
            self.store.open(before)
        return f"Inserted keys 1 to {n[0]}\nTime: {took * 1000:.0f} ms"
