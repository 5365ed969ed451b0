"""Files of any Hadoop file system."""

from strata.sources.filesystem import copy_to_local_file, copy_to_local_folder, read_file, recursively_list_all_files_in_folder, write_file

__all__ = ["copy_to_local_file", "copy_to_local_folder", "read_file", "recursively_list_all_files_in_folder", "write_file"]
