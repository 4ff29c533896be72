"""Training-data operators on texts; nothing outside this subpackage imports it."""

from __future__ import annotations


def all_plans() -> list:
    from strandline.llm import plans_p6, plans_p7, plans_p8

    return [plans_p6.R, plans_p7.R, plans_p8.R]
