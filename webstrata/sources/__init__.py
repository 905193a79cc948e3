"""Readers for finished crawls, and the stored resource table."""

from .archivebox import read_archivebox
from .httrack import read_httrack
from .katana import read_katana
from .siteone import read_siteone
from .sites import list_archivebox_sites, list_sites, list_warc_sites, sites_from_projects
from .table import load_resources, merge_resources, observed, write_resources
from .warc import damaged_warc, read_warc
from .wget import read_wget

__all__ = ["read_archivebox", "read_httrack", "read_katana", "read_siteone", "read_warc", "damaged_warc", "read_wget",
           "list_sites", "list_archivebox_sites", "list_warc_sites", "sites_from_projects",
           "load_resources", "merge_resources", "write_resources", "observed"]
