"""Classes of files: corpus class, kind of text, clusters, and their fixed orders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import paths

#: Extensions of source code and of structured data.
SOURCE = "c h cc cpp cxx hpp hh hxx rs go py js mjs ts tsx jsx java cs rb php sh bash swift kt scala lua pl cmake mk s asm m".split()
STRUCTURED = "csv json log jsonl ndjson xml yaml yml toml".split()
#: The order in which clusters are written.
ORDER = [
    "text/prose", "text/structured", "text/source", "other", "image-raw", "audio", "executable",
    "deflate-container", "png", "jpeg", "compressed", "video", "high-entropy",
]


def text_kind(path: Column) -> Column:
    """source, structured or prose, by extension."""
    ext = paths.extension(path)
    return F.when(ext.isin(SOURCE), "source").when(ext.isin(STRUCTURED), "structured").otherwise("prose")


def cluster(content_class: Column, path: Column) -> Column:
    """The cluster of a file: its content's class, and for text its kind too."""
    return F.when(content_class == "text", F.concat(F.lit("text/"), text_kind(path))).otherwise(content_class)


def cluster_rank(label: Column) -> Column:
    """The cluster's place in the fixed order; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ORDER]), label), F.lit(0)), F.lit(len(ORDER) + 1)).cast("int") - 1


# ---- corpus classes


@dataclass(frozen=True)
class Signature:
    """Bytes at offsets that make a class, for some extensions only if ``only`` names any; ``refined`` holds
    classes of extensions for which the same bytes mean something else."""

    checks: list[tuple[int, bytes]]
    kind: str
    only: list[str] = field(default_factory=list)
    refined: list[tuple[list[str], str]] = field(default_factory=list)


#: Office extensions, then signatures, the first that fits deciding.
OFFICE = "docx docm dotx xlsx xlsm pptx pptm ppsx odt ods odp".split()
STREAMS = "ts tp trp mts m2ts".split()
SIGNATURES = [
    Signature([(0, b"\xff\xd8\xff")], "photo-jpeg"),
    Signature([(0, b"\x89PNG\r\n\x1a\n")], "photo-raw-png"),
    Signature([(0, b"II*\x00")], "photo-raw-png"),
    Signature([(0, b"MM\x00*")], "photo-raw-png"),
    Signature([(0, b"BM")], "photo-raw-png", only=["bmp"]),
    Signature([(0, b"%PDF-")], "office-pdf"),
    Signature([(0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")], "office-pdf", refined=[(["msi", "msp", "mst"], "software-installed")]),
    Signature([(0, b"PK\x03\x04")], "archives-nested", refined=[(OFFICE, "office-pdf"), (["pt", "pth"], "model-weights")]),
    Signature([(0, b"PK\x05\x06")], "archives-nested"),
    Signature([(0, b"7z\xbc\xaf\x27\x1c")], "archives-nested"),
    Signature([(0, b"Rar!\x1a\x07")], "archives-nested"),
    Signature([(0, b"\x1f\x8b")], "archives-nested"),
    Signature([(0, b"\xfd7zXZ\x00")], "archives-nested"),
    Signature([(0, b"\x28\xb5\x2f\xfd")], "archives-nested"),
    Signature([(0, b"BZh")], "archives-nested", only=["bz2", "tbz", "tbz2"]),
    Signature([(257, b"ustar")], "archives-nested"),
    Signature([(0, b"MSCF")], "software-installed"),
    Signature([(0, b"MZ")], "software-installed", only="exe dll sys ocx scr efi cpl drv".split()),
    Signature([(0, b"\x7fELF")], "software-installed"),
    Signature([(0, b"\xcf\xfa\xed\xfe")], "software-installed"),
    Signature([(0, b"\xce\xfa\xed\xfe")], "software-installed"),
    Signature([(0, b"\xca\xfe\xba\xbe")], "software-installed", only=["dylib", "o", "a"]),
    Signature([(0, b"RIFF"), (8, b"WAVE")], "audio"),
    Signature([(0, b"RIFF"), (8, b"AVI ")], "video"),
    Signature([(0, b"fLaC")], "audio"),
    Signature([(0, b"ID3")], "audio"),
    Signature([(0, b"OggS")], "audio", refined=[(["ogv"], "video")]),
    *[Signature([(4, b"ftyp"), (8, brand)], "other") for brand in b"heic heix heim heis hevc hevx hevm hevs mif1 msf1 avif avis".split()],
    Signature([(4, b"ftyp"), (8, b"crx ")], "photo-raw-png"),
    Signature([(4, b"ftyp")], "video", refined=[(["m4a", "aac"], "audio")]),
    Signature([(0, b"G"), (188, b"G"), (376, b"G")], "video", only=STREAMS),
    Signature([(4, b"G"), (196, b"G"), (388, b"G")], "video", only=STREAMS),
    Signature([(0, b"\x1aE\xdf\xa3")], "video", refined=[(["mka"], "audio")]),
    Signature([(0, b"QFI\xfb")], "vm-image"),
    Signature([(0, b"KDMV")], "vm-image"),
    Signature([(0, b"conectix")], "vm-image"),
    Signature([(0, b"vhdxfile")], "vm-image"),
    Signature([(0, b"<<< Oracle VM VirtualBox Disk Image >>>")], "vm-image"),
    Signature([(0x8001, b"CD001")], "vm-image"),
    Signature([(0, b"GGUF")], "model-weights"),
]
#: Classes by extension where no signature fits.  Extensions of formats that have a signature, which a
#: file without it therefore isn't, are not here: jpg, png, pdf, docx, zip and their like are ``other`` then.
EXTENSIONS = [
    ("photo-raw-png", "dng nef cr2 cr3 arw raf orf rw2"),
    ("office-pdf", "rtf"),
    ("source-git", "rs c h cc cpp cxx hpp cs java kt py js mjs ts tsx jsx go rb php swift sh ps1 bat toml yaml yml cmake mk gradle lua sql"),
    ("logs-text", "log csv tsv json jsonl ndjson"),
    ("text-prose", "txt md rst html htm xml tex"),
    ("audio", "wav flac mp3 ogg opus m4a aac wma"),
    ("video", "mp4 mkv webm avi mov m4v wmv flv mts m2ts"),
    ("vm-image", "vmdk vdi vhd vhdx qcow2 iso"),
    ("model-weights", "safetensors gguf pt pth onnx ckpt"),
    ("software-installed", "exe dll sys ocx msi msp cab so dylib lib pdb"),
    ("game-assets", "pak unity3d assets fbx dds tga blend glb gltf bsp wad ktx"),
    ("archives-nested", "rar gz tgz xz zst bz2 tar"),
]
#: Whole names, and the words that begin the statements of a Wavefront model.
GIT_NAMES = [".gitignore", ".gitattributes", ".gitmodules"]
STATEMENTS = "v vt vn vp f l p o g s mtllib usemtl cstype deg".split()
#: Bytes of a file's head that signatures look at.
HEAD = 0x8001 + 16


def is_wavefront(head: Column) -> Column:
    """ASCII without NUL whose first line that is neither blank nor a comment begins with a statement."""
    sample = F.substring(head, 1, 1024)
    text = F.decode(sample, "ISO-8859-1")
    first = F.regexp_extract(text, r"(?m)^[\x09\x0b-\x0d\x20]*([^#\s]\S*)", 1)
    return (F.length(sample) > 0) & text.rlike(r"\A[\x01-\x7f]+\z") & first.isin(STATEMENTS)


def corpus_class(path: Column, head: Column) -> Column:
    """Below a ``.git`` folder first, then by signature, by whole name, for ``.obj`` by content, by extension."""
    ext, name = paths.extension(path), F.lower(paths.name(path))
    out = F.when(path.rlike(r"(?i)(^|/)\.git/"), "source-git")
    for s in SIGNATURES:
        fits = F.lit(True)
        for at, magic in s.checks:
            fits = fits & (F.substring(head, at + 1, len(magic)) == F.lit(magic))
        if s.only:
            fits = fits & ext.isin(s.only)
        kind = F.lit(s.kind)
        for extensions, other in reversed(s.refined):
            kind = F.when(ext.isin(extensions), other).otherwise(kind)
        out = out.when(fits, kind)
    out = out.when(name.isin(GIT_NAMES), "source-git")
    out = out.when(ext == "obj", F.when(is_wavefront(head), "game-assets").otherwise("software-installed"))
    for kind, extensions in EXTENSIONS:
        out = out.when(ext.isin(extensions.split()), kind)
    return out.otherwise("other")
