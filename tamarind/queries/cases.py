"""Questions and expressions whose entities and dates are known: the expected values that stand in for SQL."""

from __future__ import annotations

# Questions, domain, and entities they have on the day 2026-03-26.
ENTITIES = [
    ("Cho tôi xem giao dịch chuyển tiền tài khoản 123456789 trong tháng 3 năm 2025", "banking", {"account_no": "123456789", "start_date": "2025-03-01", "end_date": "2025-03-31", "transaction_type": "TRANSFER"}),
    ("Tổng số tiền tôi đã nhận trong tuần này", "banking", {"start_date": "2026-03-23", "end_date": "2026-03-26"}),
    ("Liệt kê các giao dịch trên 50 triệu trong năm 2024", "banking", {"amount_min": "50000000", "start_date": "2024-01-01", "end_date": "2024-12-31"}),
    ("Giao dịch ngoại tệ USD của tài khoản 9876543210", "banking", {"account_no": "9876543210", "currency": "USD", "transaction_type": "FX"}),
    ("Các giao dịch rút tiền qua ATM trong tháng trước", "banking", {"start_date": "2026-02-01", "end_date": "2026-02-28", "transaction_type": "WITHDRAWAL", "channel": "ATM"}),
    ("Xem giao dịch từ 01/01/2025 đến 31/03/2025 có số tiền từ 5 triệu đến 20 triệu", "banking", {"start_date": "2025-01-01", "end_date": "2025-03-31", "amount_min": "5000000", "amount_max": "20000000"}),
    ("Tài khoản 555666 đã chuyển bao nhiêu tiền trong 7 ngày gần nhất", "banking", {"account_no": "555666", "start_date": "2026-03-19", "end_date": "2026-03-26", "transaction_type": "TRANSFER"}),
    ("Giao dịch thất bại trong quý 1 năm 2025", "banking", {"status": "FAILED", "start_date": "2025-01-01", "end_date": "2025-03-31"}),
    ("Tổng tiền chuyển khoản qua internet banking hôm nay", "banking", {"start_date": "2026-03-26", "end_date": "2026-03-26", "transaction_type": "TRANSFER", "channel": "INTERNET_BANKING"}),
    ("Xem lịch sử giao dịch tiết kiệm tài khoản 111222333", "banking", {"account_no": "111222333"}),
    ("Danh sách nhân viên phòng kinh doanh", "hrm", {"department_name": "kinh doanh"}),
    ("Xem lịch sử chấm công của nhân viên EMP001 trong tháng 3", "hrm", {"employee_id": "EMP001", "start_date": "2026-03-01", "end_date": "2026-03-31"}),
    ("Nhân viên nào nghỉ phép hôm nay", "hrm", {"start_date": "2026-03-26", "end_date": "2026-03-26"}),
    ("Tổng số ngày phép còn lại của nhân viên Nguyễn Văn An", "hrm", {"employee_name": "Nguyễn Văn An"}),
    ("Liệt kê nhân viên có lương trên 15 triệu", "hrm", {"salary_min": "15000000"}),
    ("Số nhân viên đi làm muộn trong tuần trước", "hrm", {"start_date": "2026-03-16", "end_date": "2026-03-22"}),
    ("Xem đơn nghỉ phép chờ duyệt của phòng kỹ thuật", "hrm", {"department_name": "kỹ thuật"}),
    ("Nhân viên nữ đang thử việc trong công ty", "hrm", {"gender": "FEMALE", "employment_status": "PROBATION"}),
    ("Thống kê chấm công tháng 2 năm 2025 phòng nhân sự", "hrm", {"start_date": "2025-02-01", "end_date": "2025-02-28", "department_name": "nhân sự"}),
    ("Ai có nhiều ngày nghỉ phép nhất năm nay", "hrm", {"start_date": "2026-01-01", "end_date": "2026-03-26"}),
    ("Xme chấm côgn nhna viên EMP002 thágn 3", "hrm", {"employee_id": "EMP002"}),
    ("Nhân viên EMP003 có bao nhiêu tiền trong tài khoản 1234567890?", "banking", {"account_no": "1234567890"}),
    ("Liệt kê giao dịch từ 2 triệu đến 10 triệu đô la trong tháng này", "banking", {"amount_min": "2000000", "amount_max": "10000000", "start_date": "2026-03-01", "end_date": "2026-03-26"}),
    ("chuyển cho Trần Thị Bích 20tr hôm qua", "banking", {"recipient_name": "Trần Thị Bích", "amount": "20000000", "transaction_type": "TRANSFER", "start_date": "2026-03-25", "end_date": "2026-03-25"}),
    ("chuyển đến tài khoản 999888777666 từ stk 123456789", "banking", {"to_account_no": "999888777666", "account_no": "123456789", "transaction_type": "TRANSFER"}),
    ("mã giao dịch FT2603A001 đã hủy", "banking", {"trans_id": "FT2603A001", "status": "CANCELLED"}),
    ("không quá 1.500 đồng qua ngân hàng Đông Á", "banking", {"amount_max": "1500", "bank_name": "Đông Á"}),
    ("lương dưới 20 triệu ở vị trí kế toán trưởng", "hrm", {"salary_max": "20000000", "job_title": "kế toán trưởng"}),
    ("nhân viên Nguyễn Văn An ngày 12/03/2026", "hrm", {"employee_name": "Nguyễn Văn An", "attendance_date": "2026-03-12"}),
]
# Time expressions and their first and last day, on the day 2026-03-26.
TIMES = [
    ("hôm nay", "2026-03-26", "2026-03-26"),
    ("3 ngày trước", "2026-03-23", "2026-03-25"),
    ("hai tuần qua", "2026-03-12", "2026-03-26"),
    ("2 tháng gần đây", "2026-01-01", "2026-02-28"),
    ("năm ngoái", "2025-01-01", "2025-12-31"),
    ("thứ năm tuần trước", "2026-03-19", "2026-03-19"),
    ("đầu tháng", "2026-03-01", "2026-03-05"),
    ("giữa tháng 2 năm 2024", "2024-02-11", "2024-02-20"),
    ("cuối tháng", "2026-03-21", "2026-03-31"),
    ("nửa đầu tháng 2", "2026-02-01", "2026-02-15"),
    ("cuối năm", "2026-12-21", "2026-12-31"),
    ("cuối năm 2025", "2025-01-01", "2025-12-31"),
    ("giữa quý 1", "2026-02-01", "2026-02-28"),
    ("quý trước", "2025-10-01", "2025-12-31"),
    ("quý này", "2026-01-01", "2026-03-26"),
    ("ngày 30 tháng 1 năm ngoái", "2025-01-30", "2025-01-30"),
    ("tháng 3/2025", "2025-03-01", "2025-03-31"),
    ("từ giữa tháng đến cuối tháng", "2026-03-11", "2026-03-31"),
    ("2025-01-01 đến 2025-02-01", "2025-01-01", "2025-02-01"),
    ("từ 01/12/2025 đến 05/01/2026", "2025-12-01", "2026-01-05"),
    ("từ đầu năm đến nay", "2026-01-01", "2026-03-26"),
    ("cuối tuần", "2026-03-28", "2026-03-29"),
    ("từ giữa tháng tới cuối tháng", "2026-03-11", "2026-03-31"),
    ("ngày 30 tháng 1 năm kia", "2024-01-30", "2024-01-30"),
    ("đầu quý 1", "2026-01-01", "2026-01-31"),
    ("cuối quý 1", "2026-03-01", "2026-03-31"),
    ("giữa quý 1 đến cuối quý 1", "2026-02-01", "2026-03-31"),
    ("tháng này", "2026-03-01", "2026-03-31"),
    ("năm kia", "2024-01-01", "2024-12-31"),
    ("từ ngày cuối cùng của tháng về 10 ngày trước", "2026-03-22", "2026-03-31"),
    ("tính từ ngày cuối của tháng trước về 3 ngày", "2026-02-26", "2026-02-28"),
    ("chủ nhật tuần sau", "2026-04-05", "2026-04-05"),
    ("tháng 5 2 năm trước", "2024-05-01", "2024-05-31"),
    ("đầu quý này trong 5 ngày", "2026-01-01", "2026-01-05"),
    ("trong năm", "2026-01-01", "2026-03-26"),
    ("tháng trong năm 2024", "2024-01-01", "2024-12-31"),
    ("15.02.2025", "2025-02-15", "2025-02-15"),
    ("5/3/25", "2025-03-05", "2025-03-05"),
    ("2024", "2024-01-01", "2024-12-31"),
    ("3 months ago", "2025-12-01", "2026-02-28"),
    ("2 tuần tới", "2026-03-26", "2026-04-09"),
    ("năm năm trước", "2021-01-01", "2021-12-31"),
    ("hôm kia", "2026-03-24", "2026-03-24"),
]
