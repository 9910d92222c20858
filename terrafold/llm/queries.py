"""The queries of this subpackage, by name, and their SQL."""

from .ctw import op7_lm
from .decontam import OP10_SQL, op10_decontamination
from .html_text import op2_html
from .langid import op5_langid
from .licenses import OP9_SQL, op9_licenses
from .mixing import OP4_SQL, op4_mixing
from .quality import op3_quality
from .sharding import op6_sharding
from .simhash import op1_simhash
from .spelling import OP13_SQL, op13_spelling
from .token_files import op8_token_files
from .vector_codes import OP12_SQL, op12_vector_codes
from .word_bpe import op11_word_bpe

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_langid": op5_langid,
    "op6_sharding": op6_sharding,
    "op7_lm": op7_lm,
    "op8_token_files": op8_token_files,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
    "op11_word_bpe": op11_word_bpe,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {"op4_mixing": OP4_SQL, "op9_licenses": OP9_SQL, "op10_decontamination": OP10_SQL, "op12_vector_codes": OP12_SQL, "op13_spelling": OP13_SQL}
