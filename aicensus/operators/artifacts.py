"""Model artifacts: facts and risks read from file bytes. Nothing is ever loaded or executed.

Fixed-layout formats are native expressions. Length-prefixed walks (GGUF, ONNX, SavedModel,
pickle) are small readers in one Arrow job; they end where the file does.
"""

from __future__ import annotations

import io
import pickletools
import struct
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from ..session import ship_package
from ..sources.files import has_bytes_at, hex_literal, text_of
from ..sources.routing import accepted, routed
from .assets import parent_name

# Quantization label by GGUF file type.
GGUF_FILE_TYPES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 10: "Q2_K",
    11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L", 14: "Q4_K_S", 15: "Q4_K_M", 16: "Q5_K_S",
    17: "Q5_K_M", 18: "Q6_K", 19: "IQ2_XXS", 20: "IQ2_XS", 21: "Q2_K_S", 22: "IQ3_XS",
    23: "IQ3_XXS", 24: "IQ1_S", 25: "IQ4_NL", 26: "IQ3_S", 27: "IQ3_M", 28: "IQ2_S",
    29: "IQ2_M", 30: "IQ4_XS", 31: "IQ1_M", 32: "BF16",
}

# Template gadgets, Lambda signatures, callback ops, dangerous callables.
TEMPLATE_GADGETS = [
    "__globals__", "__subclasses__", "__bases__", "__mro__", "__builtins__", "__import__",
    "__class__", "__reduce__", "os.popen", "os.system", "subprocess",
]
KERAS_LAMBDA = ['"class_name": "Lambda"', '"class_name":"Lambda"']
PYFUNC_OPS = ["EagerPyFunc", "PyFunc", "PyFuncStateless"]
DANGEROUS_CALLABLES = [
    "os.system", "posix.system", "nt.system", "builtins.eval", "builtins.exec", "__builtin__.eval",
    "__builtin__.exec", "pty.spawn", "pickle.loads", "_pickle.loads", "cPickle.loads",
    "webbrowser.open", "os.popen", "posix.popen", "builtins.__import__",
]
DANGEROUS_MODULES = ["subprocess", "runpy", "socket", "importlib"]


# ── safetensors, natively ────────────────────────────────────────────────────


def little_endian(content: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian integer at a 1-based offset, as decimal(20,0)."""
    digits = F.hex(F.substring(content, offset, width))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.length(digits) == 2 * width, F.conv(swapped, 16, 10).cast("decimal(20,0)"))


def element_count(shape: Column) -> Column:
    """Product of a tensor shape; null on a negative dimension or overflow, 0 at a zero."""
    state = F.aggregate(
        shape,
        F.struct(F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("done")),
        lambda acc, d: F.when(acc["done"], acc)
        .when(d < 0, F.struct(F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("done")))
        .when(d == 0, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("done")))
        .otherwise(F.struct(
            F.try_multiply(acc["n"], d).alias("n"), F.try_multiply(acc["n"], d).isNull().alias("done"))),
    )
    return state["n"]


def safetensors_facts(files: DataFrame) -> DataFrame:
    """Tensor count, parameter count, dominant dtype and metadata, one row per valid file.

    Everything stays inside the row (higher-order functions), so nothing is shuffled.
    """
    size = little_endian(F.col("content"), 1, 8)
    rows = (
        files.withColumn("_hlen", size)
        .filter((F.col("_hlen") > 0) & (F.col("_hlen") <= F.length("content") - 8))
        .withColumn("_json", text_of(F.substring("content", F.lit(9), F.col("_hlen").cast("int"))))
        .withColumn("_t", F.from_json("_json", "map<string,struct<dtype:string,shape:array<bigint>>>"))
        .filter("_t IS NOT NULL")
    )
    tensors = F.filter(
        F.map_entries("_t"), lambda e: (e["key"] != "__metadata__") & e["value"].isNotNull()
    )
    sized = F.transform(
        tensors,
        lambda e: F.struct(e["value"]["dtype"].alias("dtype"),
                           element_count(F.coalesce(e["value"]["shape"], F.array().cast("array<bigint>"))).alias("n")),
    )
    rows = rows.withColumn("_all", sized).withColumn("_ok", F.filter("_all", lambda t: t["n"].isNotNull()))
    zero = F.lit(0).cast("bigint")
    add = lambda acc, t: F.coalesce(F.try_add(acc, t["n"]), acc)
    total = F.when(F.size("_ok") > 0, F.aggregate("_ok", zero, add))
    dtypes = F.array_sort(F.array_distinct(F.filter(F.transform("_ok", lambda t: t["dtype"]), lambda d: d != "")))
    by_dtype = F.transform(dtypes, lambda d: F.struct(
        F.aggregate(F.filter("_ok", lambda t: t["dtype"] == d), zero, add).alias("n"), d.alias("dtype")))
    most = F.array_max(F.transform(by_dtype, lambda s: s["n"]))
    dominant = F.get(F.filter(by_dtype, lambda s: s["n"] == most), F.lit(0))["dtype"]
    meta = lambda key: F.nullif(F.get_json_object("_json", f"$.__metadata__['{key}']"), F.lit(""))
    return rows.select(
        "scan_id", "path", "sha256",
        F.size("_all").alias("tensor_count"), total.alias("param_count"), dominant.alias("dtype"),
        meta("format").alias("metadata_format"),
        F.coalesce(meta("architecture"), meta("model_type"), meta("modelspec.architecture")).alias("architecture"),
    )


def safetensors_unknowns(files: DataFrame) -> DataFrame:
    """Files whose header is cut off or does not parse."""
    size = little_endian(F.col("content"), 1, 8)
    held = F.length("content") - 8
    parsed = F.from_json(text_of(F.substring("content", F.lit(9), size.cast("int"))), "map<string,string>")
    reason = F.when(size.isNull() | (size <= 0) | (held < 0), "no header").when(size > held, "the header is cut off").when(
        parsed.isNull(), "the header does not parse")
    return files.select("scan_id", "path", F.lit("modelfile/safetensors").alias("detector_id"), reason.alias("reason")).filter(
        "reason IS NOT NULL")


# ── readers, bounded by the file ──────────────────────────────────────────────────────────

_SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<B", 10: "<Q", 11: "<q", 12: "<d"}
_GGUF_STRING, _GGUF_ARRAY = 8, 9
_GGUF_INTS = {0, 1, 2, 3, 4, 5, 7, 10, 11}


class _Short(Exception):
    """The buffer ended before a value did, or a type is unknown."""

    def __init__(self, needed: int | None = None):
        self.needed = needed  # where the value ends; None where no further byte would help


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.pos = raw, 0

    def take(self, n: int) -> bytes:
        if n > len(self.raw) - self.pos:
            raise _Short(self.pos + n)
        self.pos += n
        return self.raw[self.pos - n : self.pos]

    def number(self, fmt: str):
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def sized(self) -> bytes:
        return self.take(self.number("<Q"))

    def varint(self) -> int:
        value = 0
        for i in range(10):
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << (7 * i)
            if byte < 0x80:
                return value
        raise _Short


def _gguf_value(c: _Cursor, kind: int):
    """The value at the cursor; arrays are stepped over."""
    if kind in _SCALARS:
        return c.number(_SCALARS[kind])
    if kind == _GGUF_STRING:
        return c.sized().decode("utf-8", "replace")
    if kind != _GGUF_ARRAY:
        raise _Short
    element, count = c.number("<I"), c.number("<Q")
    if element in _SCALARS:
        c.take(count * struct.calcsize(_SCALARS[element]))
    else:
        for _ in range(count):
            _gguf_value(c, element)
    return None


def gguf_header_size(raw: bytes, size: int) -> int | None:
    """Where the header of a file of ``size`` bytes ends that begins with ``raw``; None where more bytes are needed to tell."""
    c = _Cursor(raw)
    try:
        if c.take(4) == b"GGUF" and c.number("<I") in (2, 3):
            c.take(8)
            for _ in range(c.number("<Q")):
                c.sized()
                _gguf_value(c, c.number("<I"))
        return c.pos
    except _Short as short:  # a value that ends behind the file has no end to read up to
        return None if short.needed is not None and short.needed <= size else min(len(raw), size)


def gguf_header(raw: bytes) -> dict | None:
    """Facts of a GGUF header; metadata that breaks off keeps what was read."""
    c = _Cursor(raw)
    try:
        if c.take(4) != b"GGUF" or (version := c.number("<I")) not in (2, 3):
            return None
    except _Short:
        return None
    facts = {"version": str(version)}
    wanted = {
        "general.architecture": "architecture", "general.name": "name",
        "general.quantization_version": "quantization_version", "general.file_type": "file_type",
        "general.parameter_count": "parameter_count", "tokenizer.chat_template": "chat_template",
    }
    text_keys = {"architecture", "name", "chat_template"}
    try:
        c.take(8)
        for _ in range(c.number("<Q")):
            key = c.sized().decode("utf-8", "replace")
            kind = c.number("<I")
            value = _gguf_value(c, kind)
            name = wanted.get(key)
            if name in text_keys and kind == _GGUF_STRING and value:
                facts[name] = value
            elif name and name not in text_keys and kind in _GGUF_INTS:
                facts[name] = str(min(value, (1 << 63) - 1))
    except _Short:
        facts["broken"] = "the metadata breaks off"
    return facts


def onnx_header(raw: bytes) -> dict | None:
    """Top-level facts of an ONNX model; null unless a producer or an IR version was seen."""
    c, facts = _Cursor(raw), {}
    try:
        while c.pos < len(raw):
            field, wire = divmod(c.varint(), 8)
            if wire == 0:
                value = c.varint()
                if field == 1:
                    facts["ir_version"] = str(value - (1 << 64) if value >> 63 else value)
            elif wire == 1:
                c.take(8)
            elif wire == 2:
                payload = c.take(c.varint())
                if field in (2, 3):
                    try:
                        text = payload.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if text:
                        facts["producer_name" if field == 2 else "producer_version"] = text
                elif field == 7:
                    facts["graph"] = "true"
            elif wire == 5:
                c.take(4)
            else:
                break
    except _Short:
        pass
    if not facts.keys() & {"producer_name", "ir_version"}:
        return None
    arch = facts.get("producer_name", "").strip()
    if arch and all(ch >= " " for ch in arch):
        facts["architecture"] = arch
    return facts


def is_savedmodel(raw: bytes) -> bool:
    """Only the two SavedModel fields, with their wire types, and at least one meta graph."""
    c, graph = _Cursor(raw), False
    try:
        while c.pos < len(raw):
            field, wire = divmod(c.varint(), 8)
            if (field, wire) == (1, 0):
                c.varint()
            elif (field, wire) == (2, 2):
                n = c.varint()
                graph = True
                if n > len(raw) - c.pos:
                    return True
                c.take(n)
            else:
                return False
    except _Short:
        return False
    return graph


def pickle_globals(raw: bytes) -> list[str]:
    """'module.name' of every global a pickle names.

    Each opcode's declared effect is applied to a stack of texts (empty where a value is no text), so names
    that a later opcode takes from the stack or the memo are known whatever lies between.
    """
    found: list[str] = []
    stack: list = []
    memo: dict[int, str] = {}
    mark = pickletools.markobject
    text = lambda x: x if isinstance(x, str) else ""
    try:
        for op, arg, _ in pickletools.genops(raw):
            if op.name in ("GLOBAL", "INST"):
                found.append(arg.replace(" ", ".", 1))
            elif op.name == "STACK_GLOBAL":
                module, name = ["", "", *map(text, stack)][-2:]
                found.append(f"{module}.{name}")
            elif op.name.endswith("PUT") or op.name == "MEMOIZE":
                memo[len(memo) if op.name == "MEMOIZE" else arg] = text(stack[-1]) if stack else ""
            if op.stack_before == op.stack_after:
                continue
            takes = len(op.stack_before)
            if mark in op.stack_before:
                takes = op.stack_before.index(mark)
                while stack and stack.pop() is not mark:
                    pass
            taken = [stack.pop() for _ in range(min(takes, len(stack)))]
            value = memo.get(arg, "") if op.name.endswith("GET") else text(taken[0]) if op.name == "DUP" and taken else text(arg)
            stack.extend(mark if kind is mark else value for kind in op.stack_after)
    except Exception:  # noqa: BLE001 - malformed opcodes end the walk, what was found stays
        pass
    return found


def torch_facts(raw: bytes) -> dict | None:
    if raw.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = [i for i in z.namelist() if i.rsplit("/", 1)[-1] == "data.pkl"]
            return {"format": "torch-zip", "globals": [g for n in names for g in pickle_globals(z.read(n))]}
    if raw[:1] == b"\x80":
        return {"format": "torch-pickle", "globals": pickle_globals(raw)}
    return None


ARTIFACTS = (
    "scan_id string, path string, sha256 string, detector_id string, format string, "
    "facts map<string,string>, globals array<string>, error string"
)


def _read_artifact(detector: str, raw: bytes):
    """(format, facts, globals) of one file, or None."""
    if detector == "modelfile/gguf":
        facts = gguf_header(raw)
        return facts and ("gguf", facts, [])
    if detector == "modelfile/onnx":
        facts = onnx_header(raw)
        return facts and ("onnx", facts, [])
    if detector == "modelfilex/savedmodel":
        return ("tensorflow-savedmodel", {}, []) if is_savedmodel(raw) else None
    facts = torch_facts(raw)
    return facts and (facts["format"], {}, facts["globals"])


_READERS = ["modelfile/gguf", "modelfile/onnx", "modelfilex/savedmodel", "modelfilex/torch"]


def artifact_facts(files: DataFrame) -> DataFrame:
    """One Arrow pass over the files of the four walked formats; failures become ``error`` rows."""
    ship_package(files.sparkSession)
    detector = F.coalesce(*[F.when(accepted(files, d), F.lit(d)) for d in _READERS])
    rows = routed(files, *_READERS).withColumn("_det", detector).filter("_det IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for scan_id, path, sha, det, raw in batch.itertuples(index=False, name=None):
                try:
                    got = _read_artifact(det, bytes(raw))
                    if got:
                        out.append((scan_id, path, sha, det, *got, None))
                except Exception as err:  # noqa: BLE001 - one bad file is one unknown
                    out.append((scan_id, path, sha, det, None, None, None, f"{type(err).__name__}: {err}"))
            yield pd.DataFrame(out, columns=[
                "scan_id", "path", "sha256", "detector_id", "format", "facts", "globals", "error"])

    return rows.select("scan_id", "path", "sha256", "_det", "content").mapInPandas(run, ARTIFACTS)


# ── screens and findings ─────────────────────────────────────────────────────


def _risk(risk_id: str, detail: Column) -> Column:
    """One-risk array, or null when the detail is empty."""
    return F.when(F.size(detail) > 0, F.array(F.struct(F.lit(risk_id).alias("id"), detail.alias("detail"))))


def dangerous_globals(names: Column) -> Column:
    """Sorted distinct dangerous callables among a pickle's globals."""
    modules = "|".join(DANGEROUS_MODULES)
    hit = F.filter(names, lambda n: n.isin(DANGEROUS_CALLABLES) | n.rlike(rf"^(?:{modules})\.[^.]*$"))
    return F.array_sort(F.array_distinct(hit))


def template_gadgets(template: Column) -> Column:
    tokens = F.array(*[F.lit(t) for t in sorted(TEMPLATE_GADGETS)])
    return F.filter(tokens, lambda t: F.contains(F.coalesce(template, F.lit("")), t))


def keras_lambda(content: Column) -> Column:
    hit = reduce(lambda a, b: a | b, [F.contains(content, hex_literal(s.encode().hex())) for s in KERAS_LAMBDA])
    return F.when(hit, F.array(F.lit("Lambda"))).otherwise(F.array().cast("array<string>"))


def pyfunc_ops(content: Column) -> Column:
    """Callback ops, matched with the length byte that frames them."""
    hits = [
        F.when(F.contains(content, hex_literal((bytes([len(op)]) + op.encode()).hex())), F.lit(op)) for op in PYFUNC_OPS
    ]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


_MODEL_NULLS = {
    "task": "string", "architecture": "string", "param_count": "bigint", "quantization": "string",
    "context_length": "bigint", "format": "string", "base_model": "string",
}


def model_facet(**given: Column) -> Column:
    return F.struct(*[
        given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _MODEL_NULLS.items()
    ])


def _weights(df: DataFrame, detector: Column, confidence: Column, name: Column | None = None) -> DataFrame:
    sha = F.when(F.col("sha256").isNotNull(), F.array(F.struct(
        F.lit("SHA-256").alias("alg"), F.col("sha256").alias("hex"))))
    return df.withColumns({
        "kind": F.lit("local-model-file"), "provider": F.lit("local"), "hashes": sha,
        "name": basename(F.col("path")) if name is None else name,
        "detector_id": detector, "method": F.lit("binary-analysis"), "confidence": confidence,
        "line": F.lit(0), "col": F.lit(0),
    })


def safetensors_findings(files: DataFrame) -> DataFrame:
    rows = safetensors_facts(routed(files, "modelfile/safetensors"))
    keep = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    fields = keep(F.create_map(
        F.lit("tensor_count"), F.col("tensor_count").cast("string"), F.lit("dtype"), F.col("dtype"),
        F.lit("parameter_count"), F.col("param_count").cast("string"),
        F.lit("metadata.format"), F.col("metadata_format"), F.lit("architecture"), F.col("architecture"),
    ))
    rows = rows.withColumn("fields", fields).withColumn("model", model_facet(
        format=F.lit("safetensors"), param_count=F.col("param_count"), quantization=F.col("dtype"),
        architecture=F.col("architecture")))
    return _weights(rows, F.lit("modelfile/safetensors"), F.lit(0.95))


def walked_findings(facts: DataFrame, pyfunc: DataFrame | None = None) -> DataFrame:
    """Findings of the walked formats; screens run natively on the extracted facts."""
    labels = F.create_map(*[x for k, v in GGUF_FILE_TYPES.items() for x in (F.lit(str(k)), F.lit(v))])
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    label = F.when(fact("file_type").isNotNull(), F.coalesce(
        F.try_element_at(labels, fact("file_type")), F.concat(F.lit("ftype_"), fact("file_type"))))
    danger = dangerous_globals(F.col("globals"))
    rows = facts.filter("error IS NULL").withColumns({
        "_danger": danger,
        "model": model_facet(format=F.col("format"), architecture=fact("architecture"), quantization=label,
                             param_count=fact("parameter_count").try_cast("bigint")),
        "fields": F.map_filter("facts", lambda k, v: ~k.isin("chat_template", "broken") & v.isNotNull()),
    })
    risks = F.coalesce(
        _risk("RISK-PICKLE-IMPORT", F.col("_danger")),
        _risk("RISK-GGUF-TEMPLATE", template_gadgets(fact("chat_template"))),
        _risk("RISK-SAVEDMODEL-PYFUNC", F.col("_ops")) if pyfunc is not None else F.lit(None).cast(
            "array<struct<id:string,detail:array<string>>>"),
    )
    if pyfunc is not None:
        rows = rows.join(pyfunc, ["scan_id", "path"], "left")
    confidence = (
        F.when(F.col("detector_id") == "modelfile/gguf", 0.95)
        .when((F.col("detector_id") == "modelfilex/torch") & (F.size("_danger") > 0), 0.95)
        .otherwise(0.9)
    )
    name = F.when(F.col("detector_id") == "modelfilex/savedmodel",
                  parent_name(F.col("path"), "saved_model.pb")).otherwise(basename(F.col("path")))
    return _weights(rows.withColumn("risks", risks), F.col("detector_id"), confidence, name)


def savedmodel_ops(files: DataFrame) -> DataFrame:
    """Callback ops per SavedModel file, without shipping content to Python."""
    return routed(files, "modelfilex/savedmodel").select("scan_id", "path", pyfunc_ops(F.col("content")).alias("_ops"))


def signature_findings(files: DataFrame) -> DataFrame:
    """HDF5, TFLite and TensorRT: recognized by signature or byte shape."""
    c = F.col("content")
    engine = (F.length(c) >= 16) & F.decode(c, "ISO-8859-1").rlike(
        "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x80-\\xff]")
    fmt = (
        F.when(accepted(files, "modelfilex/hdf5") & has_bytes_at(c, 1, "894844460D0A1A0A"), "hdf5")
        .when(accepted(files, "modelfilex/tflite") & has_bytes_at(c, 5, "54464C33"), "tflite")
        .when(accepted(files, "modelfilex/tensorrt") & engine, "tensorrt")
    )
    wanted = routed(files, "modelfilex/hdf5", "modelfilex/tflite", "modelfilex/tensorrt")
    rows = wanted.withColumn("_fmt", fmt).filter("_fmt IS NOT NULL").withColumn(
        "model", model_facet(format=F.col("_fmt"))
    ).withColumn("risks", F.when(F.col("_fmt") == "hdf5", _risk("RISK-KERAS-LAMBDA", keras_lambda(c))))
    confidence = F.when(F.col("_fmt") == "hdf5", 0.85).when(F.col("_fmt") == "tflite", 0.9).otherwise(0.7)
    return _weights(rows, F.concat(F.lit("modelfilex/"), "_fmt"), confidence).drop("_fmt", "content")


def artifact_findings(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    facts = artifact_facts(files) if facts is None else facts
    columns = ["scan_id", "path", "kind", "name", "provider", "hashes", "model", "fields", "risks",
               "detector_id", "method", "confidence", "line", "col"]
    parts = [safetensors_findings(files), walked_findings(facts, savedmodel_ops(files)), signature_findings(files)]
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [p.select(*[c for c in columns if c in p.columns]) for p in parts],
    )
