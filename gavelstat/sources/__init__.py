"""Tables in and out: star sources, profiles, feature sets, results and run history."""
