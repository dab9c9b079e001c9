"""Where documents are kept: files, the change log, segments and snapshots."""
