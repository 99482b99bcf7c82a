"""Where rows come from: directories of files, markdown notes, persisted indexes."""
