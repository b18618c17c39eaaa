"""The corpus queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that defines it.
MODULES = {
    "op1_suffix_repetition": "repetition",
    "op2_context_mixing_files": "token_files",
    "op3_source_mixing": "mixing",
    "op10_golay_simhash": "simhash",
    "op7_bm25_decontamination": "decontamination",
    "op4_byte_gru_language": "language",
    "op5_chained_passages": "passages",
    "op6_suffix_array_dedup": "substrings",
    "op8_hypergeometric_shards": "sharding",
    "op9_line_suffix_dedup": "lines",
    "op11_embedding_whitening": "whitening",
    "op12_merkle_manifest": "merkle",
    "op13_url_filter": "url_filter",
}


#: Imported at once, so that what is missing shows here.
_LOADED = {name: import_module(f"{__package__}.{module}") for name, module in MODULES.items()}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _LOADED.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _LOADED.items():
        sql = getattr(module, name.split("_")[0].upper() + "_SQL", None)
        if sql:
            found[name] = sql
    return found
