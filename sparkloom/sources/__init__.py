"""Where rows and models come from."""
