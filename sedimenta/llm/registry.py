"""The queries of this package, and their SQL where SQL can express them."""

from . import cws, decontam, html, langid, packing, pii, quality, secrets, simhash, substring

QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality": quality.op3_quality,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_simhash": simhash.op6_simhash,
    "op7_pii": pii.op7_pii,
    "op8_weighted_sampling": cws.op8_weighted_sampling,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLE_SQL = {
    "op2_secret_scan": secrets.ORACLE,
    "op4_substring_dedup": substring.ORACLE,
    "op9_decontamination": decontam.ORACLE,
}
