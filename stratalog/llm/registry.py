"""The subpackage's queries, and SQL for those that SQL can express."""

from . import mixing, rules, urls
from .hmm import op8_hmm
from .kneser import op9_kneser
from .langid import op1_langid
from .mixing import op10_mixing
from .neighbours import op3_neighbours
from .packing import op4_packing
from .pii import op7_pii
from .rules import op6_rules
from .simhash import op5_simhash
from .urls import op2_urls

QUERIES = {f.__name__: f for f in (op1_langid, op2_urls, op3_neighbours, op4_packing, op5_simhash, op6_rules, op7_pii, op8_hmm, op9_kneser, op10_mixing)}


def oracles() -> dict[str, str]:
    return {"op2_urls": urls.oracle(), "op6_rules": rules.oracle(), "op10_mixing": mixing.ORACLE}
