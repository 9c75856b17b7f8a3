"""All queries of the library."""

from tesserae.queries import duplicates as _duplicates  # noqa: F401
from tesserae.queries import media as _media  # noqa: F401
from tesserae.queries import palettes as _palettes  # noqa: F401
from tesserae.queries import tags as _tags  # noqa: F401
from tesserae.queries import prompts as _prompts  # noqa: F401
from tesserae.queries import scoring as _scoring  # noqa: F401
from tesserae.queries import renames as _renames  # noqa: F401
from tesserae.queries import vectors as _vectors  # noqa: F401
from tesserae.queries import models as _models  # noqa: F401
from tesserae.queries import images as _images  # noqa: F401
from tesserae.queries import analysis as _analysis  # noqa: F401
from tesserae.queries.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
