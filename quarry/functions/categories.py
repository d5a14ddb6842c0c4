"""Categories of file extensions, and the words that name them in queries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each category, in both languages the words that name it.
EXTENSIONS = {
    "document": "doc docx docm dot dotx odt ott fodt rtf epub pages wpd",
    "pdf": "pdf",
    "spreadsheet": "xls xlsx xlsm ods ots csv tsv numbers",
    "presentation": "ppt pptx pptm odp otp key",
    "image": "jpg jpeg png gif webp svg bmp tif tiff heic heif avif raw cr2 nef arw dng psd xcf kra ico",
    "audio": "mp3 flac ogg oga opus wav m4a aac wma aiff mid midi",
    "video": "mp4 mkv webm avi mov wmv m4v mpg mpeg 3gp ogv",
    "archive": "zip tar gz tgz bz2 xz zst 7z rar iso deb rpm dmg appimage flatpak jar",
    "text": "txt text md markdown rst org adoc asciidoc tex bib csv tsv log json xml yaml yml toml ini cfg conf srt vtt sub nfo"
    " rs py js ts jsx tsx c h cc cpp hpp java kt go rb php sh bash zsh fish lua pl swift cs sql css scss vue svelte dart r m"
    " scala zig nim ex exs erl hs ml el clj vim diff patch desktop properties gradle cmake mk html htm xhtml",
}
NAMES = {
    "document": "doc docs document documents documento documentos",
    "pdf": "pdf pdfs",
    "spreadsheet": "sheet sheets spreadsheet spreadsheets hoja hojas excel",
    "presentation": "slides presentation presentations presentacion presentación presentaciones",
    "text": "text texto code codigo código",
    "image": "image images imagen imagenes imágenes photo photos foto fotos",
    "audio": "audio music musica música sound",
    "video": "video videos vídeo vídeos movie movies",
    "archive": "archive archives archivo comprimido comprimidos",
}
#: The first category that lists an extension has it.
BY_EXTENSION: dict[str, str] = {}
for _category, _exts in EXTENSIONS.items():
    for _ext in _exts.split():
        BY_EXTENSION.setdefault(_ext, _category)
BY_NAME = {word: category for category, words in NAMES.items() for word in words.split()}


def category_of(ext: Column) -> Column:
    """The category of a lower-case extension; 'other' if none lists it."""
    table = F.create_map(*[F.lit(x) for x in chain(*sorted(BY_EXTENSION.items()))])
    return F.coalesce(F.try_element_at(table, F.coalesce(ext, F.lit(""))), F.lit("other"))


def type_filter(word: str) -> tuple[str, str] | None:
    """('category' or 'ext', value) for a type word; None if it is neither."""
    w = word.lower()
    if w in BY_NAME:
        return "category", BY_NAME[w]
    return ("ext", w) if w.isascii() and w.isalnum() else None
