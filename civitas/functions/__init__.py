"""Column expressions: every function takes and returns a
``Column`` built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen.  Nothing here is a Python UDF: the per-row Python
helpers of the source (hash, classify, cap, mask, format — udf_rowwise) are
all built-in expressions."""

from civitas.functions.dates import (date_dmy, date_iso_prefix, date_two_formats,  # noqa: F401
                                     month_key, month_label, month_windows,
                                     period_label, year_from_date_or_text)
from civitas.functions.flags import (bool_parse_3, flag_map, flag_prefix,  # noqa: F401
                                     null_flag, vote_flags)
from civitas.functions.ids import (digits_only, doc_format, doc_type, id_to_text,  # noqa: F401
                                   mask_sentinel, parse_identifier, safe_int, stable_id,
                                   surrogate_md5)
from civitas.functions.labels import coalesce_label, label_map, lookup_label  # noqa: F401
from civitas.functions.money import (brl_to_decimal, brl_to_number_lenient,  # noqa: F401
                                     cap_value, money_format, to_money)
from civitas.functions.text import (blank_to_null, normalize_name_nfkd,  # noqa: F401
                                    normalize_name_sql, null_to_blank, upper_trim)
