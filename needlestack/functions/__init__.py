from .columns import (  # noqa: F401
    binarize, finite, id_key, ln_positive, missing_to_null, round_class, two_class,
)
