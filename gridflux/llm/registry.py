"""Queries of the corpus operators, and SQL for those that SQL can express."""

from gridflux.llm.decontaminate import op10_decontaminate
from gridflux.llm.html import op4_html
from gridflux.llm.langid import op7_langid
from gridflux.llm.licenses import op1_licenses
from gridflux.llm.linededup import OP9_SQL, op9_linededup
from gridflux.llm.packing import op6_packing
from gridflux.llm.quality import op5_quality
from gridflux.llm.simhash import op2_simhash
from gridflux.llm.toxicity import op3_toxicity
from gridflux.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_langid": op7_langid,
    "op8_warc": op8_warc,
    "op9_linededup": op9_linededup,
    "op10_decontaminate": op10_decontaminate,
}

SQL = {"op8_warc": OP8_SQL, "op9_linededup": OP9_SQL}
