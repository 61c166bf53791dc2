"""Jobs that users of the library run: each a function of a session and paths, a command line and a config file."""
