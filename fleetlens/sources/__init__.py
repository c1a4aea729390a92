"""Where rows come from: broker messages, serial text, stored tables."""
