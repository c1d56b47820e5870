"""Tables, files and the partitioned log lake."""
