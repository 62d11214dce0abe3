"""Every named view as a query."""

from __future__ import annotations

from functools import partial

from passagelink.plans.catalog import VIEWS, open_view, view_sql
from passagelink.queries import register


def _open(spark, d, name):
    return open_view(spark, d, name)


for _name in VIEWS:
    register(view_sql(_name), name=_name)(partial(_open, name=_name))
