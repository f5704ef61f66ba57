"""Where rows come from and go to: responses, command lines, rule files, the JSON interface, text output."""
