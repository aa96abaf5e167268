"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, crosstok, fim, licenses, nndescent, orderminhash, packing, quality, rabitdup, secrets, sharding, toxicity, urlfilter

QUERIES = {
    "op1_nn_descent": nndescent.query,
    "op2_quality_rules": quality.query,
    "op3_secret_scans": secrets.query,
    "op4_toxicity": toxicity.query,
    "op5_bpe": bpe.query,
    "op6_license_scans": licenses.query,
    "op7_url_filters": urlfilter.query,
    "op8_sharding": sharding.query,
    "op9_packing": packing.query,
    "op10_order_minhash": orderminhash.query,
    "op11_rotation_codes": rabitdup.query,
    "op12_tokenizer_alignment": crosstok.query,
    "op13_fim": fim.query,
}

ORACLE_SQL = {
    "op7_url_filters": urlfilter.ORACLE,
    "op13_fim": fim.ORACLE,
}
