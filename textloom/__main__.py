"""Command line: a file, an address or standard input to Markdown.

    python -m textloom FILE [-o OUT] [-x EXT] [-m TYPE] [-c CHARSET] [-p] [--list-plugins] [--keep-data-uris]
"""

from __future__ import annotations

import argparse
import os
import sys

from textloom.sources import formats, info, registry


class ToolError(Exception):
    """A failure told without paths or traces."""


def convert(data: bytes, known: info.Info, plugins: bool = False, **options) -> str:
    readers = registry.with_plugins() if plugins else registry.default()
    return readers.convert(data, known, **options)[0]


def convert_to_markdown(uri: str) -> str:
    """Markdown of a file: or data: address, for tools: failures say what kind they are and nothing of this machine."""
    try:
        data, known = info.open_uri(uri)
    except OSError as e:
        raise ToolError(f"Could not read the resource: {os.strerror(e.errno) if e.errno else 'the resource could not be read'}.") from e
    except ValueError as e:
        raise ToolError(str(e)) from e
    try:
        return convert(data, known)
    except formats.Unsupported as e:
        raise ToolError("No reader takes this kind of file.") from e
    except ValueError as e:
        raise ToolError("File conversion failed.") from e


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textloom", description="Files to Markdown.")
    p.add_argument("file", nargs="?", help="a path, a file: or data: address; standard input without one")
    p.add_argument("-o", "--output", help="write here instead of to standard output")
    p.add_argument("-x", "--extension", help="extension of standard input")
    p.add_argument("-m", "--mime-type", help="type of the input")
    p.add_argument("-c", "--charset", help="character set of the input")
    p.add_argument("-p", "--use-plugins", action="store_true", help="load plugins")
    p.add_argument("--list-plugins", action="store_true", help="name the plugins and stop")
    p.add_argument("--keep-data-uris", action="store_true", help="keep embedded pictures whole")
    a = p.parse_args(argv)
    if a.list_plugins:
        print("\n".join(registry.plugin_names()) or "no plugins")
        return 0
    ext = None if a.extension is None else "." + a.extension.strip().lower().lstrip(".")
    charset = info.canonical_charset(a.charset)
    if a.mime_type is not None and a.mime_type.count("/") != 1:
        p.error(f"not a type: {a.mime_type}")
    try:
        if a.file is None:
            data, known = sys.stdin.buffer.read(), info.Info()
        elif a.file.lower().startswith(("file:", "data:", "http:", "https:")):
            data, known = info.open_uri(a.file)
        else:
            with open(a.file, "rb") as f:
                data, known = f.read(), info.of_path(a.file)
        text = convert(data, known.merge(info.Info(extension=ext, mimetype=a.mime_type, charset=charset)), a.use_plugins, keep_data_uris=a.keep_data_uris)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.buffer.write(text.encode(sys.stdout.encoding or "utf-8", "replace") + b"\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
