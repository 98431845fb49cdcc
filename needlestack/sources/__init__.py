from .catalogs import read_id_list, without_marker, write_ids  # noqa: F401
from .scratch import checkpoint_root, materialize, scratch_path  # noqa: F401
from .statlog import (  # noqa: F401
    finite_min, load_labelled, load_target, managed_table, read_stat_table, union_classes,
)
