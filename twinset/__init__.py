"""twinset: exact-duplicate analysis of file trees and content tables on Spark."""

from .functions.rule import MatchRule
from .operators.analyze import analyze, dir_matches, file_matches, records
from .operators.describe import describe_children, describe_duplicates
from .operators.difftree import diff_tree, node_status
from .operators.index import assign_ec, import_signatures, refresh_apply, refresh_plan, signatures
from .operators.repository import IndexNotFound, Repository, read_report
from .sources.catalog import catalog_from_table
from .sources.filesystem import catalog_from_fs
from .sources.settings import IndexSettings

__all__ = [
    "IndexNotFound", "IndexSettings", "MatchRule", "Repository", "analyze", "assign_ec", "catalog_from_fs", "catalog_from_table", "describe_children", "describe_duplicates",
    "diff_tree", "dir_matches", "file_matches", "import_signatures", "node_status", "read_report", "records", "refresh_apply", "refresh_plan", "signatures",
]
