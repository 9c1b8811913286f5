"""Sources: graphs over relations, fixtures, files, documents and SQL catalogs."""
