"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import op1_quality_classifier as op1
from . import op10_repeats as op10
from . import op11_importance_resampling as op11
from . import op12_secret_scans as op12
from . import op13_fill_in_middle as op13
from . import op2_line_dedup as op2
from . import op3_licenses as op3
from . import op4_warc as op4
from . import op5_decontamination as op5
from . import op6_packing as op6
from . import op7_near_dedup as op7
from . import op8_quality_rules as op8
from . import op9_url_filters as op9


def queries() -> dict[str, Callable]:
    return {
        "op1_quality_classifier": op1.op1_quality_classifier,
        "op2_line_dedup": op2.op2_line_dedup,
        "op3_licenses": op3.op3_licenses,
        "op4_warc": op4.op4_warc,
        "op5_decontamination": op5.op5_decontamination,
        "op6_packing": op6.op6_packing,
        "op7_near_dedup": op7.op7_near_dedup,
        "op8_quality_rules": op8.op8_quality_rules,
        "op9_url_filters": op9.op9_url_filters,
        "op10_repeats": op10.op10_repeats,
        "op11_importance_resampling": op11.op11_importance_resampling,
        "op12_secret_scans": op12.op12_secret_scans,
        "op13_fill_in_middle": op13.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": op2.SQL, "op4_warc": op4.SQL, "op7_near_dedup": op7.SQL, "op5_decontamination": op5.SQL, "op9_url_filters": op9.SQL, "op10_repeats": op10.SQL, "op11_importance_resampling": op11.SQL, "op12_secret_scans": op12.SQL, "op13_fill_in_middle": op13.SQL}
