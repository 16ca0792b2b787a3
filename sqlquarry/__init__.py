"""Analytics over bodies of SQL text on Spark: findings, references, joins, identities and similarity of statements."""

from .options import ScanOptions

__all__ = ["ScanOptions", "scan", "scan_table"]


def scan(spark, root, options=None, exclude=()):
    """Scans the files below a folder; see plans.scan.Scan for the relations."""
    from .plans.scan import scan as run

    return run(spark, root, options or ScanOptions(), exclude)


def scan_table(corpus, options=None):
    """Scans a table of path, text, encoding."""
    from .plans.scan import scan_table as run

    return run(corpus, options or ScanOptions())
