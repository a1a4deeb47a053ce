"""Readers and engines that need a library, model or service this engine does not bring: interfaces that say what is missing.

Pass an implementation as `run` to use one; without it each reports MissingDependency, and a file comes back with that error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.sources import formats


class MissingDependency(ValueError):
    """What would do this is not installed."""


@dataclass(frozen=True)
class External:
    """A capability that is plugged in: what it does, what it needs, and the function that does it."""

    name: str
    needs: str
    run: Callable | None = None

    def __call__(self, *args, **options):
        if self.run is None:
            raise MissingDependency(f"{self.name} needs {self.needs}")
        return self.run(*args, **options)


#: name: what it needs
NEEDS = {
    "pdf_words": "a PDF library", "pdf_pages_ocr": "a PDF renderer and an OCR engine", "gazette_pdf": "PDF and font libraries", "old_sheets": "a reader of BIFF sheets", "image_metadata": "exiftool 12.24 or newer",
    "image_caption": "a language model", "audio_metadata": "exiftool 12.24 or newer", "transcript": "a speech model", "ocr": "an OCR engine", "cloud_layout": "a document extraction service", "cloud_content": "a multimodal extraction service",
    "translate_indic": "a translation model", "translate_nllb": "a translation model", "translate_cloud": "a translation service", "model_download": "a network", "assistant": "a language model", "pdf_print": "a browser",
}
CAPABILITIES = {name: External(name, needs) for name, needs in NEEDS.items()}


def plug(name: str, run: Callable) -> External:
    """The capability with this function behind it, kept for later calls."""
    CAPABILITIES[name] = External(name, NEEDS[name], run)
    return CAPABILITIES[name]


def _reader(*names: str):
    def read(data: bytes, **options) -> tuple[str, str | None]:
        parts = []
        for n in names:
            got = CAPABILITIES[n](data, **options)
            parts.append(got if isinstance(got, str) else "\n".join(f"{k}: {v}" for k, v in got.items()))
        return "\n\n".join(parts), None

    read.__name__ = "read_" + names[0]
    return read


#: Types of files that external readers take; fixed values.
for _exts, _names in (
    ([".pdf"], ["pdf_words"]), ([".xls"], ["old_sheets"]), ([".jpg", ".jpeg", ".png"], ["image_metadata", "image_caption"]), ([".wav", ".mp3", ".m4a", ".mp4"], ["audio_metadata", "transcript"]),
):
    formats.register(_exts, _reader(*_names))


#: Metadata keys that are told of pictures and of sound, in order; fixed values.
IMAGE_KEYS = ["ImageSize", "Title", "Caption", "Description", "Keywords", "Artist", "Author", "DateTimeOriginal", "CreateDate", "GPSPosition"]
AUDIO_KEYS = ["Title", "Artist", "Author", "Band", "Album", "Genre", "Track", "DateTimeOriginal", "CreateDate", "NumChannels", "SampleRate", "AvgBytesPerSec", "BitsPerSample"]


def metadata_lines(metadata: Column, keys: list[str]) -> Column:
    """'key: value' lines of the wanted keys that a map holds, in the keys' order."""
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{k}: "), F.try_element_at(metadata, F.lit(k))) for k in keys])), "\n")


def first_success(*tries: Column, otherwise: str) -> Column:
    """The first attempt that is neither null nor blank, else a notice."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in tries], F.lit(otherwise))


#: Extensions by how their content is made out by an extraction service; fixed values.
MODALITIES = {"audio": [".wav", ".mp3", ".m4a"], "video": [".mp4", ".mov", ".avi"], "image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff"]}


def modality(extension: Column) -> Column:
    """audio, video, image or document."""
    out = F.lit("document")
    for kind, exts in MODALITIES.items():
        out = F.when(F.lower(extension).isin(exts), kind).otherwise(out)
    return out
