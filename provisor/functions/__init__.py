"""Column functions: every name here maps columns to columns."""

from provisor.functions.cells import (  # noqa: F401
    documented_code, export_cell, json_merge, sha256_hex, to_typed, web_url,
)
from provisor.functions.codes import (  # noqa: F401
    code_lists, code_spellings, first_code, is_code_like, letter_count, strict_code,
)
from provisor.functions.composition import (  # noqa: F401
    allergen_block, clean_composition, composition_block, fuzzy_spans, is_composition,
    is_sufficient, to_cyrillic_lookalikes,
)
from provisor.functions.ids import name_uuid  # noqa: F401
from provisor.functions.names import (  # noqa: F401
    clean_description, english_name, escaped_names, excerpt, script_language, taxonomy_key,
)
from provisor.functions.severity import (  # noqa: F401
    assess, base_severity, risk_base, severity_name, severity_weight, verdict_level,
)
from provisor.functions.text import (  # noqa: F401
    apply_corrections, collapse_spaces, is_negated, normalize_text, split_label,
    strip_invisible,
)
