"""Where rows and graphs come from and go to."""
