from duelframe.sources.files import infer_types, load_or_build, read_csv, read_plain_csv, write_predictions
from duelframe.sources.models import ModelBundle, first_loadable, tree_nodes

__all__ = [
    "ModelBundle",
    "first_loadable",
    "infer_types",
    "load_or_build",
    "read_csv",
    "read_plain_csv",
    "tree_nodes",
    "write_predictions",
]
