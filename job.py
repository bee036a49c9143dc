"""spark-submit entry: job.py <data vertices> <data edges> <query vertices> <query edges> <output> <work folder>"""

import sys

from tagweave.job import main

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
