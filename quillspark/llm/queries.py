"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from quillspark.llm import decontam, lexical, secret_ledger, warc
from quillspark.llm.alignment import op12_alignment
from quillspark.llm.bpe import op9_bpe
from quillspark.llm.decontam import op6_decontam
from quillspark.llm.langid import op3_langid
from quillspark.llm.lexical import op13_lexical
from quillspark.llm.licenses import op2_licenses
from quillspark.llm.media import op1_media
from quillspark.llm.quality import op10_quality
from quillspark.llm.repeats import op8_suffix_dedup
from quillspark.llm.secret_ledger import op11_secrets
from quillspark.llm.simhash import op4_simhash
from quillspark.llm.toxicity import op5_toxicity
from quillspark.llm.warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_media, op2_licenses, op3_langid, op4_simhash, op5_toxicity, op6_decontam, op7_warc, op8_suffix_dedup, op9_bpe, op10_quality, op11_secrets, op12_alignment, op13_lexical)}
SQL: dict[str, str] = {"op6_decontam": decontam.SQL, "op7_warc": warc.SQL, "op11_secrets": secret_ledger.SQL, "op13_lexical": lexical.SQL}
