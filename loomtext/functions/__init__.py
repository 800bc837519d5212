"""See the README for the list of modules in this subpackage."""
