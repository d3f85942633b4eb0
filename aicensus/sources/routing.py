"""Which detectors see which file, and which detectors run at all."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extension, matches_glob
from .files import has_bytes_at


@dataclass(frozen=True)
class Selector:
    """Routing of one detector: path entries are OR-ed, the other dimensions AND-ed."""

    detector_id: str
    basenames: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    magics: tuple[tuple[int, str], ...] = ()  # (0-based offset, hex bytes)
    max_size: int = 0  # a limit only where a caller sets one
    tags: tuple[str, ...] = field(default=())

    def accepts(self, by_content: bool = True, base: Column | None = None, ext: Column | None = None) -> Column:
        """The selector as one predicate over a ``files`` row; without content, over its path, size and language.

        ``base`` and ``ext`` are the path's last segment and its extension where the caller has them.
        """
        path = F.col("path")
        base, ext = basename(path) if base is None else base, extension(path) if ext is None else ext
        dims: list[Column] = []
        ways: list[Column] = []
        if self.basenames:
            ways.append(base.isin(*self.basenames))
        if self.extensions:
            ways.append(ext.isin(*self.extensions))
        if self.globs:
            ways.append(matches_glob(path, *self.globs))
        if ways:
            hit = ways[0]
            for w in ways[1:]:
                hit = hit | w
            dims.append(hit)
        if self.max_size:
            dims.append(F.col("size") <= self.max_size)
        if self.languages:
            dims.append(F.col("language").isin(*self.languages))
        if self.magics and by_content:
            hit = F.lit(False)
            for offset, digits in self.magics:
                hit = hit | F.coalesce(has_bytes_at(F.col("content"), offset + 1, digits), F.lit(False))
            dims.append(hit)
        out = F.lit(True)
        for d in dims:
            out = out & d
        return out


# Routing of the shipped detectors, in registration order.
SELECTORS = [
    Selector("dataset/file", extensions=(".csv", ".jsonl", ".parquet", ".arrow"), tags=("asset",)),
    Selector("gosrc/ast", extensions=(".go",), languages=("go",), tags=("source",)),
    Selector(
        "infra/compose",
        basenames=("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"),
        tags=("infra",),
    ),
    Selector(
        "infra/dockerfile", basenames=("Dockerfile",), globs=("**/Dockerfile", "**/*.Dockerfile"), tags=("infra",)
    ),
    Selector("manifest/nuget", extensions=(".csproj",), tags=("manifest",)),
    Selector("manifest/cargo", basenames=("Cargo.toml",), tags=("manifest",)),
    Selector("manifest/gomod", basenames=("go.mod",), tags=("manifest",)),
    Selector("manifest/gradle", basenames=("build.gradle", "build.gradle.kts"), tags=("manifest",)),
    Selector("manifest/maven", basenames=("pom.xml",), tags=("manifest",)),
    Selector("manifest/npm", basenames=("package.json",), tags=("manifest",)),
    Selector("manifest/pypi-pyproject", basenames=("pyproject.toml",), tags=("manifest",)),
    Selector(
        "manifest/pypi-requirements",
        basenames=("requirements.txt",), globs=("**/requirements*.txt",), tags=("manifest",),
    ),
    Selector("modelfile/gguf", extensions=(".gguf",), tags=("modelfile",)),
    Selector("modelfile/onnx", extensions=(".onnx",), tags=("modelfile",)),
    Selector("modelfile/safetensors", extensions=(".safetensors",), tags=("modelfile",)),
    Selector(
        "modelfilex/hdf5",
        extensions=(".h5", ".hdf5", ".keras"), magics=((0, "894844460D0A1A0A"),), tags=("modelfile",),
    ),
    Selector("modelfilex/savedmodel", basenames=("saved_model.pb",), tags=("modelfile",)),
    Selector("modelfilex/tflite", extensions=(".tflite",), magics=((4, "54464C33"),), tags=("modelfile",)),
    Selector("modelfilex/tensorrt", extensions=(".engine", ".plan"), tags=("modelfile",)),
    Selector(
        "modelfilex/torch",
        extensions=(".pt", ".pth", ".bin"), magics=((0, "504B0304"), (0, "80")), tags=("modelfile",),
    ),
    Selector(
        "prompt/file",
        extensions=(".prompt",),
        globs=("**/prompts/**", "**/*.prompt", "**/*.prompt.txt", "**/*.jinja", "**/*.jinja2", "**/*.j2"),
        tags=("asset",),
    ),
    Selector(
        "ruleengine",
        languages=("python", "javascript", "typescript", "go", "java", "rust", "csharp", "kotlin"),
        tags=("rules",),
    ),
]


def selector(detector_id: str) -> Selector:
    return next(s for s in SELECTORS if s.detector_id == detector_id)


# The column of a stored files table that tells which detectors read a file: "|id|id|", the partition of its rows.
ROUTES = "_routes"


def accepted(files: DataFrame, detector_id: str) -> Column:
    """Whether a detector reads a row: looked up where the files were routed, evaluated otherwise."""
    return F.col(ROUTES).contains(f"|{detector_id}|") if ROUTES in files.columns else selector(detector_id).accepts()


def routed(files: DataFrame, *detector_ids: str) -> DataFrame:
    """Files that one of the detectors reads. Of a stored table only the partitions that hold them."""
    return files.filter(reduce(lambda a, b: a | b, [accepted(files, d) for d in detector_ids]))


def with_routes(files: DataFrame, extra: dict[str, Column], selectors: list[Selector] | None = None) -> DataFrame:
    """Every selector evaluated once, as ROUTES; ``extra`` names further readers. No reader: ''."""
    path, base, ext = F.col("path"), F.col("_base"), F.col("_ext")
    ways = {s.detector_id: s.accepts(base=base, ext=ext) for s in (SELECTORS if selectors is None else selectors)} | extra
    ids = F.concat_ws("|", F.lit(""), *[F.when(hit, F.lit(name)) for name, hit in ways.items()], F.lit(""))
    return files.withColumns({"_base": basename(path), "_ext": extension(path)}).withColumn(
        ROUTES, F.regexp_replace(ids, r"^\|$", "")).drop("_base", "_ext")


def read_by_some(files: DataFrame) -> DataFrame:
    """The routed files that some detector reads.

    A filter on ROUTES would be moved in front of the routing, with every selector in it once more; rows of a lambda are not.
    """
    held = F.explode(F.filter(F.array(ROUTES), lambda r: r != "")).alias(ROUTES)
    return files.select(*[held if c == ROUTES else c for c in files.columns])


def route(files: DataFrame, selectors: list[Selector] | None = None) -> DataFrame:
    """One row per (file, detector). Narrow: each file's detectors are an array, exploded.

    The selectors are plan-time configuration, so no join or shuffle is needed and a file
    matched by two path entries of one detector still appears once.
    """
    selectors = SELECTORS if selectors is None else selectors
    hits = F.array(
        *[F.when(s.accepts(), F.struct(F.lit(i).alias("reg"), F.lit(s.detector_id).alias("detector_id")))
          for i, s in enumerate(selectors)]
    )
    return (
        files.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
        .select("scan_id", "path", "size", F.col("_hit.reg").alias("reg"), F.col("_hit.detector_id").alias("detector_id"))
    )


def select_detectors(
    expression: str, selectors: list[Selector] | None = None
) -> list[tuple[Selector, str]]:
    """Apply a selection expression: bare tokens replace, ``+x`` adds, ``-x`` removes.

    Returns the chosen selectors in registration order with the token that chose each.
    """
    selectors = SELECTORS if selectors is None else selectors
    tokens = [t.strip() for t in expression.split(",") if t.strip()]
    if any(t in "+-" for t in tokens):
        raise ValueError("dangling + or - in the selection")
    plain = [t for t in tokens if t[0] not in "+-"]

    def matching(name: str) -> list[str]:
        ids = [s.detector_id for s in selectors if name in ("all", s.detector_id) or name in s.tags]
        if not ids and name != "all":
            raise ValueError(f"{name!r} matches no detector id or tag")
        return ids

    matches = {t: matching(t.lstrip("+-") if t[0] in "+-" else t) for t in tokens}
    chosen = {s.detector_id: "default" for s in selectors} if not plain else {}
    for t in plain:
        chosen.update(dict.fromkeys(matches[t], t))
    for t in tokens:
        if t[0] == "+":
            chosen.update(dict.fromkeys(matches[t], t))
        elif t[0] == "-":
            for gone in matches[t]:
                chosen.pop(gone, None)
    return [(s, chosen[s.detector_id]) for s in selectors if s.detector_id in chosen]

