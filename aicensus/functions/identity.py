"""Component identity: class, normalized key, stable id, package URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_set, pep503, strip

ID_PREFIX = "asset:"

# Identity class of each kind. Kinds of one class share an identity.
KIND_CLASS = {
    "hosted-llm": "hosted-model",
    "embedding-model": "hosted-model",
    "local-model-file": "weights-file",
    "framework": "package",
    "library": "package",
    "vector-db": "vecdb",
    "prompt": "prompt",
    "dataset": "dataset",
    "ai-config": "ai-config",
    "infra": "infra",
    "service": "infra",
    "rag-pipeline": "rag",
    "application": "app",
}

# The more specific kind of a class wins.
KIND_PRECEDENCE = {
    "embedding-model": 3,
    "framework": 2,
    "service": 2,
    "hosted-llm": 1,
    "library": 1,
    "infra": 1,
}

# Names of one asset seen under different spellings.
NAME_ALIASES = {
    "chromadb": "chroma",
    "pinecone-client": "pinecone",
    "pinecone": "pinecone",
    "qdrant-client": "qdrant",
    "weaviate-client": "weaviate",
    "weaviate-ts-client": "weaviate",
    "pymilvus": "milvus",
    "milvus": "milvus",
    "faiss-cpu": "faiss",
    "faiss-gpu": "faiss",
    "llama-index": "llamaindex",
    "llama_index": "llamaindex",
    "haystack-ai": "haystack",
    "dspy-ai": "dspy",
    "pyautogen": "autogen",
    "openai-sdk": "openai",
    "anthropic-sdk": "anthropic",
    "@anthropic-ai/sdk": "anthropic",
    "cohere-sdk": "cohere",
    "cohere-ai": "cohere",
    "mistralai-sdk": "mistralai",
    "@mistralai/mistralai": "mistralai",
    "groq-sdk": "groq",
    "ollama-sdk": "ollama",
    "voyageai-sdk": "voyageai",
}

# Vendors seen under different spellings.
PROVIDER_ALIASES = {
    "hugging face": "huggingface",
    "mistral ai": "mistral",
    "voyage ai": "voyage",
    "llama-index": "llamaindex",
}


def _lookup(table: dict, key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(literal, key)


def kind_class(kind: Column) -> Column:
    return F.coalesce(_lookup(KIND_CLASS, kind), kind)


def kind_precedence(kind: Column) -> Column:
    return F.coalesce(_lookup(KIND_PRECEDENCE, kind), F.lit(0))


def normalize_provider(provider: Column) -> Column:
    low = F.lower(strip(F.coalesce(provider, F.lit(""))))
    return F.coalesce(_lookup(PROVIDER_ALIASES, low), low)


# A snapshot date at the end of a hosted-model name; the whole name has 12 bytes or more.
DATE_SUFFIX = r"^(?s)(.+)-([0-9]{4}-[0-9]{2}-[0-9]{2})$"


def normalize_name(cls: Column, name: Column, ecosystem: Column) -> Column:
    raw = strip(F.coalesce(name, F.lit("")))
    low = F.lower(raw)
    pkg = F.when(ecosystem == "pypi", pep503(raw)).otherwise(low)
    undated = F.regexp_extract(low, DATE_SUFFIX, 1)
    return (
        F.when(cls == "hosted-model", F.when(undated != "", undated).otherwise(low))
        .when(cls.isin("package", "vecdb"), F.coalesce(_lookup(NAME_ALIASES, pkg), pkg))
        .when(cls.isin("weights-file", "prompt", "dataset"), F.regexp_replace(raw, "^/+|/+$", ""))
        .otherwise(low)
    )


def snapshot_version(cls: Column, name: Column) -> Column:
    """Date suffix of a hosted-model name, '' otherwise."""
    low = F.lower(strip(F.coalesce(name, F.lit(""))))
    return F.when(cls == "hosted-model", F.regexp_extract(low, DATE_SUFFIX, 2)).otherwise("")


def first_sha256(hashes: Column) -> Column:
    """Lower-case hex of the first SHA-256 of a claim, '' if none."""
    sha = F.filter(hashes, lambda h: F.lower(h["alg"]) == "sha-256")
    return F.coalesce(F.lower(F.get(sha, F.lit(0))["hex"]), F.lit(""))


def discriminator(cls: Column, cname: Column, ecosystem: Column, sha: Column) -> Column:
    return (
        F.when(
            cls == "weights-file",
            F.when(sha != "", F.concat(F.lit("sha256:"), sha)).otherwise(F.concat(F.lit("path:"), cname)),
        )
        .when(cls == "package", F.coalesce(ecosystem, F.lit("")))
        .otherwise("")
    )


def component_id(cls: Column, provider: Column, name: Column, disc: Column) -> Column:
    key = F.concat_ws("\x00", cls, provider, name, disc)
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))


# Package-URL types by ecosystem and what is lower-cased in them.
PURL_ECOSYSTEMS = ["pypi", "npm", "golang", "maven", "cargo", "nuget"]
_LOWER_NAMESPACE = ["npm", "golang"]
_LOWER_NAME = ["pypi", "npm", "golang"]


def purl_encode(c: Column) -> Column:
    """Percent-encode each path segment the way package URLs want it."""
    out = F.url_encode(c)
    # How the built-in form encoding differs from path-segment escaping.
    for have, want in [
        ("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%3D", "="),
        ("%3A", ":"), ("%2F", "/"),
    ]:
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def package_purl(ecosystem: Column, namespace: Column, name: Column, version: Column) -> Column:
    """pkg:<type>/<namespace>/<name>@<version>; null for an unknown ecosystem or no name."""
    eco = F.lower(ecosystem)
    ns = F.coalesce(F.when(eco.isin(_LOWER_NAMESPACE), F.lower(namespace)).otherwise(namespace), F.lit(""))
    low = F.when(eco.isin(_LOWER_NAME), F.lower(name)).otherwise(name)
    final = F.when(eco == "pypi", pep503(low)).otherwise(low)
    url = F.concat(
        F.lit("pkg:"), eco, F.lit("/"),
        F.when(ns != "", F.concat(purl_encode(ns), F.lit("/"))).otherwise(""),
        purl_encode(final),
        F.when(is_set(version), F.concat(F.lit("@"), purl_encode(version))).otherwise(""),
    )
    return F.when(eco.isin(PURL_ECOSYSTEMS) & is_set(name), url)


def generic_purl(name: Column, sha256: Column) -> Column:
    url = F.concat(F.lit("pkg:generic/"), purl_encode(name), F.lit("?checksum=sha256:"), F.lower(sha256))
    return F.when(is_set(name) & is_set(sha256), url)


def huggingface_purl(namespace: Column, name: Column, revision: Column) -> Column:
    url = F.concat(
        F.lit("pkg:huggingface/"), purl_encode(F.lower(namespace)), F.lit("/"), purl_encode(F.lower(name)),
        F.when(is_set(revision), F.concat(F.lit("@"), purl_encode(revision))).otherwise(""),
    )
    return F.when(is_set(namespace) & is_set(name), url)


def oci_purl(name: Column, digest: Column) -> Column:
    url = F.concat(
        F.lit("pkg:oci/"), purl_encode(F.lower(name)),
        F.when(is_set(digest), F.concat(F.lit("@"), purl_encode(digest))).otherwise(""),
    )
    return F.when(is_set(name), url)
