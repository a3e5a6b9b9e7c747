"""Column expressions."""

from raterspark.functions.nulls import (
    if_else3,
    in_set,
    n_distinct_na,
    not_in,
    paste0,
    safe_div,
    sentinel_to,
    sum_na_rm,
    sum_strict,
)
from raterspark.functions.text import (
    capitalize_first,
    compose_text,
    first_balanced_block,
    first_json_block,
    first_line,
    fold_ascii,
    json_key_text,
    keep_name_chars,
    parse_status,
    remove_spaces,
    strip_list_marks,
    title_key,
    tokens,
    trim_ws,
)

__all__ = [
    "capitalize_first", "compose_text", "first_balanced_block", "first_json_block",
    "first_line", "fold_ascii", "if_else3", "in_set", "json_key_text", "keep_name_chars",
    "n_distinct_na", "not_in", "parse_status", "paste0", "remove_spaces", "safe_div",
    "sentinel_to", "strip_list_marks", "sum_na_rm", "sum_strict", "title_key", "tokens",
    "trim_ws",
]
