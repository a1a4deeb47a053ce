"""First-match dispatch: readers by priority over guesses of a file's type, and discovery of plugins."""

from __future__ import annotations

import functools
import importlib.metadata
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from textloom.sources import external, feeds, formats, info, office, rich, web  # noqa: F401  (they register their readers)

PLUGINS = "textloom.plugin"


@dataclass(frozen=True)
class Entry:
    """A reader of files that accepts(data, info) says it takes; lower priorities are tried first, newer ones before older."""

    name: str
    accepts: Callable[[bytes, info.Info], bool]
    read: Callable[..., tuple[str, str | None]]
    priority: float = 0.0
    order: int = 0


@dataclass
class Registry:
    entries: list[Entry] = field(default_factory=list)

    def register(self, name: str, accepts, read, priority: float = 0.0) -> None:
        self.entries.append(Entry(name, accepts, read, priority, len(self.entries)))

    def ranked(self) -> list[Entry]:
        return sorted(self.entries, key=lambda e: (e.priority, -e.order))

    def convert(self, data: bytes, known: info.Info, **options) -> tuple[str, str | None, str]:
        """(Markdown, title, reader's name): the first reader in rank that takes a guess and succeeds; with nothing known last.

        Raises Unsupported if none takes it, else ValueError with all failures.
        """
        failed, tried = [], set()
        for guess in [*info.guesses(data, known), info.Info()]:
            for e in self.ranked():
                if (e.name, guess) in tried or not e.accepts(data, guess):
                    continue
                tried.add((e.name, guess))
                try:
                    text, title = e.read(data, name=known.filename or "(unknown)", url=known.url, charset=guess.charset, **options)
                    return formats.normalize(text), title, e.name
                except Exception as x:  # a reader's failure passes the file on
                    failed.append(f"{e.name}: {type(x).__name__}: {x}")
        if failed:
            raise ValueError("; ".join(failed))
        raise formats.Unsupported(known.filename or "(unknown)")


def by_type(extensions: list[str], mimes: list[str]):
    """Accepts files of these extensions or types (by prefix)."""
    return lambda data, i: (i.extension or "").lower() in extensions or any((i.mimetype or "").lower().startswith(m) for m in mimes)


#: Types by prefix of readers that take them besides extensions; fixed values.
MIMES = {
    "read_csv": ["text/csv", "application/csv"], "read_html": ["text/html", "application/xhtml"], "read_notebook": ["application/json"], "read_zip": ["application/zip"],
    "read_text": ["text/", "application/json", "application/markdown"], "read_rtf": ["text/rtf", "application/rtf"],
}


def _is_html(data: bytes, i: info.Info) -> bool:
    return by_type([".html", ".htm"], MIMES["read_html"])(data, i)


@functools.cache
def default() -> Registry:
    """The engine's readers: plain text and pages last, addresses that have readers of their own first."""
    out = Registry()
    taken: dict = {}
    for ext, readers in formats.READERS.items():
        for r in readers:
            taken.setdefault(r, []).append(ext)
    for read, extensions in sorted(taken.items(), key=lambda x: x[0] is not formats.read_text):  # of equal priority, plain text is tried last
        if read is formats.read_text:
            out.register("read_text", lambda data, i, own=by_type(extensions, MIMES["read_text"]): own(data, i) or i.charset is not None, read, 10.0)
        elif read is formats.read_notebook:
            out.register("read_notebook", lambda data, i, own=by_type(extensions, MIMES["read_notebook"]): own(data, i) and b'"nbformat"' in data and b'"nbformat_minor"' in data, read)
        else:
            out.register(read.__name__, by_type(extensions, MIMES.get(read.__name__, [])), read, 10.0 if read in (formats.read_html, formats.read_zip) else 0.0)
    for name, pattern, read in web.SITES:
        out.register(name, lambda data, i, p=pattern: bool(p.match(i.url or "")) and _is_html(data, i), read)
    return out


def with_plugins(found=None) -> Registry:
    """default() and what plugins register; a plugin that fails is reported and left out."""
    out = Registry(list(default().entries))
    for point in importlib.metadata.entry_points(group=PLUGINS) if found is None else found:
        try:
            point.load().register_converters(out)
        except Exception as e:
            warnings.warn(f"plugin {point.name} was not loaded: {e}", stacklevel=2)
    return out


def plugin_names() -> list[str]:
    return sorted(p.name for p in importlib.metadata.entry_points(group=PLUGINS))
