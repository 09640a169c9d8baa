"""Column types of the registered queries where DuckDB's own differ in width: the SQL is cast to them."""

CASTS = {
    "b02_equal_sizes": "n integer",
    "b29_ragged": "n integer",
    "d05_prepare": "total bigint, parts bigint",
    "t49_add": "n integer",
    "t52_replace": "ids bigint, n bigint",
    "a03_masked_var": "n bigint",
    "a12_lengths": "prompt bigint, response bigint",
    "a14_throughput": "tokens bigint",
    "a27_mismatches": "n integer",
    "a33_unbalance": "least bigint, most bigint, spread bigint",
    "a34_extents": "in_range bigint",
    "b15_lists_by_key": "n integer",
    "b20_repeat_by_count": "rep integer",
    "b21_unfold": "n integer, part integer",
    "b26_minibatches": "epoch integer",
    "b31_sizes": "text_bytes bigint",
    "b33_gather_ragged": "n integer",
    "b34_concat_ragged": "n integer",
    "b39_padded_to_ragged": "n integer, width integer",
    "b44_length_filter": "n integer",
    "b45_segments": "n integer",
    "b47_suffix_budget": "size integer",
    "d01_balance_totals": "chars bigint",
    "d03_equal_parts": "parts bigint",
    "f03_last_token_score": "n integer",
    "f09_table_function": "last integer",
    "f12_generator": "n integer",
    "j02_tiered_match": "n_nationkey integer",
    "j11_cross_similarity": "rank integer",
    "k02_views": "rank integer",
    "k13_search": "place integer",
    "m11_token_bucket": "n integer",
    "n19_clip": "size bigint",
    "n21_rejection": "kept_tokens bigint",
    "n22_veto": "kept bigint",
    "n23_masks_and_weights": "after bigint",
    "n33_round_up": "parts bigint, size bigint",
    "s10_steps": "ids bigint",
    "s12_responses": "n integer",
    "s14_fan_out": "k bigint",
    "s23_step_order": "place integer",
    "t34_token_amount": "tokens bigint",
    "t47_group_scene": "n integer",
    "t48_flatten": "groups integer, objects integer, total bigint",
    "t50_remove": "n integer",
    "t53_apply_edits": "n integer, ids integer",
    "t57_prompt_rows": "n integer",
    "u02_self_repeat": "copy integer",
    "w01_gae": "n integer",
    "w07_history": "used bigint",
    "w08_inverse_permutation": "at integer, was integer",
    "w11_packing_order": "slot integer",
}


def cast(name: str, sql: str) -> str:
    """The query's SQL with its columns in the types that the Spark query gives."""
    if name not in CASTS:
        return sql
    columns = [c.rsplit(" ", 1) for c in CASTS[name].split(", ")]
    return f"select * replace ({', '.join(f'cast("{c}" as {t}) as "{c}"' for c, t in columns)}) from ({sql})"
