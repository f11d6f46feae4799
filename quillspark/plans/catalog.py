"""All registered queries and their SQL."""

from quillspark.plans import audited, lists, practice, privacy, registry, retrieved, rows, texts, wording  # noqa: F401

QUERIES, SQL, FLAGSHIP = registry.QUERIES, registry.SQL, registry.FLAGSHIP
