"""The functions that the engine promises, by category. Names are those that
``call`` takes; ``extend.resolve`` tells their kinds, and a test resolves every one."""

from __future__ import annotations

SCALAR = {
    "math": "abs ceil ceiling floor round bround sqrt cbrt exp ln log10 log2 pow pmod sign sin cos tan asin acos atan atan2 sinh cosh tanh degrees radians greatest least rand random truncate width_bucket is_nan is_finite is_infinite infinity nan pi e power log to_base from_base cosine_similarity",
    "null": "coalesce nullif equal_null isnan nanvl if is_null",
    "bitwise": "bitwise_and bitwise_or bitwise_xor bitwise_not bitwise_left_shift bitwise_right_shift shiftleft shiftright bit_count bitwise_logical_shift_right bitwise_arithmetic_shift_right",
    "string": "concat concat_ws upper lower substr substring length trim ltrim rtrim lpad rpad replace reverse split split_part instr locate strpos levenshtein soundex translate initcap repeat to_utf8 from_utf8 chr codepoint strrpos starts_with ends_with split_to_map levenshtein_distance hamming_distance",
    "regex": "rlike regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count regexp_split regexp_position",
    "binary": "md5 sha1 sha2 sha256 crc32 xxhash64 hex unhex base64 unbase64 url_encode url_decode parse_url to_hex from_hex to_base64 from_base64 to_base64url from_base64url sha512 url_extract_protocol url_extract_host url_extract_port url_extract_path url_extract_query url_extract_fragment url_extract_parameter",
    "time": "date_trunc date_add date_sub date_diff add_months months_between year quarter month day hour minute second dayofweek day_of_week dayofyear day_of_year last_day from_unixtime unix_timestamp to_timestamp from_utc_timestamp to_utc_timestamp date_format make_interval day_of_month dow doy week week_of_year year_of_week yow millisecond to_unixtime date_parse format_datetime parse_datetime from_iso8601_date from_iso8601_timestamp to_iso8601 last_day_of_month",
    "array": "array element_at subscript get array_distinct array_sort sort_array array_contains contains array_position array_min array_max arrays_overlap array_intersect array_union array_except slice flatten sequence shuffle transform filter aggregate reduce zip_with exists forall size cardinality any_match all_match none_match find_first array_average array_sum array_sort_desc array_frequency array_duplicates array_has_duplicates array_remove array_join trim_array ngrams zip",
    "map": "map map_from_arrays map_from_entries map_keys map_values map_entries map_concat map_filter transform_keys transform_values map_zip_with map_subset map_top_n multimap_from_entries",
    "json": "get_json_object json_extract_scalar json_tuple from_json to_json parse_json variant_get json_array_length json_extract json_parse json_format json_size json_array_get json_array_contains",
}

AGGREGATE = "count count_if sum avg min max min_by max_by bool_and bool_or every any_value arbitrary array_agg collect_list collect_set set_agg stddev stddev_samp stddev_pop variance var_samp var_pop corr covar_samp covar_pop skewness kurtosis regr_count regr_slope regr_intercept regr_r2 approx_count_distinct approx_distinct approx_percentile percentile median mode bit_and bit_or bit_xor bitwise_and_agg bitwise_or_agg bitwise_xor_agg hll_sketch_agg hll_union_agg approx_set merge histogram_numeric listagg geometric_mean map_agg multimap_agg map_union map_union_sum set_union histogram numeric_histogram entropy checksum"

WINDOW = "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value"

OPERATOR = "add between divide equal greater_than greater_than_or_equal is_distinct_from less_than less_than_or_equal modulus multiply negation not_equal subtract subscript random"


def names() -> list[str]:
    return [n for group in (*SCALAR.values(), AGGREGATE, WINDOW, OPERATOR) for n in group.split()]
